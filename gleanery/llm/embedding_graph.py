"""Near-duplicates among embeddings by a robust-pruned flat graph.

1. Equal vectors are one node, carried by its smallest vec_id. Centres are fitted on a bounded sample of nodes; every
   node goes to the shard of its nearest centre (its home) and, where shards overlap, to other shards whose border is
   nearer than ``slack`` times the linking distance, those of the nearest borders if they are too many. A shard above ``cell`` nodes is dealt in slices of bounded size.
2. In each slice the neighbours of a node are pruned robustly: a candidate goes if a nearer kept one covers it. The
   lists of all shards that a node is in are united into one graph.
3. The nodes of a home search the slices of its shard: greedily from the medoid, and from what a node's own list has there, over the united lists; wherever
   the search meets nodes in range, it goes on through all of their neighbours until no more are in range. What it finds is
   verified by cosine in double precision. Each pair is credited to both ends once: where both ends ask in one cell, what one
   finds counts for both; where the mirrored pair meets in another cell, both cells compare such pairs exactly; where it
   meets nowhere, the one cell credits both.
4. The recall is audited: the nodes of all rows whose id is divisible by 100, copies of smaller ids too, are compared with all
   nodes, in blocks. The target holds for the sum of links, for the mean of the rows and for the mean of each class of
   link counts. While one is below, the graph is built again with a larger slack and more shards a node; at slack 1 no pair can lie outside the
   searched shards, and if the search still misses links, the cells are compared exactly.

A slice returns a link count and one parent for each node, never a row for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import connected_components, grouped, materialize, roots, small

DEGREE, BEAM, CANDIDATES = 24, 48, 64
CELL = ["shard", "i", "j"]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def stacked(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, step: int = 1024) -> np.ndarray:
    """Centres of ``x`` by Lloyd's rounds from evenly spaced rows; an empty centre keeps its place. Rows meet the centres in blocks of ``step``."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        half = 0.5 * (centres * centres).sum(axis=1)
        at = np.concatenate([(x[low : low + step] @ centres.T - half).argmax(axis=1) for low in range(0, len(x), step)])
        for c in range(k):
            if len(own := x[at == c]):
                centres[c] = own.mean(axis=0)
    return centres


def apart(some: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances between ``some`` centres and all."""
    size = (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(0, (some * some).sum(axis=1)[:, None] + size - 2 * some @ centres.T))


def homes(x: np.ndarray, centres: np.ndarray, reach: float, most: int | None = None, step: int = 1024) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home of each row, and all shards whose border with the home is nearer than ``reach``; with ``most``, the so many of nearest border. Rows go in blocks of
    ``step``, with the distances of their own homes to the other centres: those between all centres would grow with the square of their number."""
    home, shards = np.empty(len(x), np.int64), []
    for at in range(0, len(x), step):
        far = (centres * centres).sum(axis=1) - 2 * x[at : at + step] @ centres.T
        rows = np.arange(len(far))
        own = far.argmin(axis=1)
        between = apart(centres[own], centres)
        border = (far - far[rows, own][:, None]) / np.maximum(2 * between, 1e-300)
        border[between == 0] = 0  # an equal centre
        border[rows, own] = -1
        if most is not None and most < len(centres):
            rest = np.argpartition(border, most - 1, axis=1)[:, most:]
            np.put_along_axis(border, rest, np.inf, 1)
        home[at : at + step] = own
        shards += [np.flatnonzero(b) for b in border <= reach + 1e-12]
    return home, shards


def prune(x: np.ndarray, alpha: float = 1.2) -> list[np.ndarray]:
    """Robustly pruned neighbours of each row among all rows of a slice, and edges that make every row reachable from the medoid."""
    n, keep = len(x), min(CANDIDATES, len(x) - 1)
    out: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n if keep > 0 else 0, 128):
        sims = x[at : at + 128] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -9
        near = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        vectors = x[near]
        among = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))))
        alive = np.ones(near.shape, bool)
        for _ in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            for r in np.flatnonzero(some).tolist():
                out[at + r].add(int(near[r, first[r]]))
            alive &= (alpha * among[rows, first] > own) | ~some[:, None]
            alive[rows, first] = False
    for a in range(n):
        for b in list(out[a]):
            if len(out[b]) < 2 * DEGREE:
                out[b].add(a)
    start = medoid(x)
    seen = np.zeros(n, bool)
    while True:
        front = [start]
        seen[start] = True
        while front:
            front = [b for b in {b for a in front for b in out[a]} if not seen[b]]
            seen[front] = True
        rest = np.flatnonzero(~seen)
        if not len(rest):
            break
        inside = np.flatnonzero(seen)
        start = int(rest[0])
        out[int(inside[(x[inside] @ x[start]).argmax()])].add(start)
    return [np.array(sorted(o), np.int64) for o in out]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _padded(lists: list[np.ndarray], n: int) -> np.ndarray:
    """The lists as rows of one array; n stands for no neighbour."""
    sizes = np.array([len(own) for own in lists], np.int64)
    out = np.full((len(lists), max(1, int(sizes.max(initial=0)))), n, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(lists) if len(lists) else 0
    return out


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, threshold: float, seeds: list[np.ndarray] | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with cosine at ``threshold`` or more that a range-expanding greedy search over ``lists`` finds. It starts
    from the medoid, and for a query with ``seeds`` (its own neighbours in the graph) from these too."""
    n = len(x)
    adjacent = _padded(lists, n)
    width = adjacent.shape[1]
    begin = _padded(seeds, n) if seeds is not None else None
    padded = np.vstack([x, np.zeros(x.shape[1])])
    start, beam, found = medoid(x), min(BEAM, n), ([], [])
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[:, start] = True
        ids = np.full((len(q), beam), n)
        sims = np.full((len(q), beam), -9.0)
        ids[:, 0], sims[:, 0] = start, q @ x[start]
        opened = ids == n
        hits = [(rows[sims[:, 0] >= threshold - 1e-9], ids[sims[:, 0] >= threshold - 1e-9, 0])]
        if begin is not None:
            first = np.where(begin[at : at + block] == start, n, begin[at : at + block])
            seen[rows[:, None], first] = True
            near = np.where(first < n, np.einsum("qd,qwd->qw", q, padded[first]), -9.0)
            r, c = np.nonzero(near >= threshold - 1e-9)
            hits.append((r, first[r, c]))
            ids, sims = np.hstack([ids, first]), np.hstack([sims, near])
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            opened = ids == n
        while not opened.all():
            pick = np.where(opened, -9.0, sims).argmax(axis=1)
            live = np.flatnonzero(~opened[rows, pick])
            opened[rows, pick] = True
            next_ids = adjacent[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], next_ids]
            seen[live[:, None], next_ids] = True
            next_sims = np.where(fresh, np.einsum("qd,qwd->qw", q[live], padded[next_ids]), -9.0)
            r, c = np.nonzero(next_sims >= threshold - 1e-9)
            hits.append((live[r], next_ids[r, c]))
            all_ids = np.hstack([ids[live], np.where(fresh, next_ids, n)])
            all_sims = np.hstack([sims[live], next_sims])
            all_open = np.hstack([opened[live], ~fresh])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
            opened |= sims < -8
        # the range grows from every row found until its neighbours bring no more
        a, b = (np.concatenate(h) for h in zip(*hits))
        while len(a):
            found[0].append(at + a)
            found[1].append(b)
            more_a, more_b = [], []
            for lo in range(0, len(a), 4096):
                qa, nb = np.repeat(a[lo : lo + 4096], width), adjacent[b[lo : lo + 4096]].ravel()
                fresh = ~seen[qa, nb]
                qa, nb = qa[fresh], nb[fresh]
                if not len(qa):
                    continue
                qa, nb = np.divmod(np.unique(qa * (n + 1) + nb), n + 1)
                seen[qa, nb] = True
                near = np.einsum("nd,nd->n", q[qa], padded[nb]) >= threshold - 1e-9
                more_a.append(qa[near])
                more_b.append(nb[near])
            a = np.concatenate(more_a) if more_a else np.empty(0, np.int64)
            b = np.concatenate(more_b) if more_b else np.empty(0, np.int64)
    if not found[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found[0]), np.concatenate(found[1])


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length."""
    sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(sizes == d)))


def _assign(centres: dict[int, tuple[int, np.ndarray]], reach: float, most: int | None):
    """``centres``: of each vector length, with the number of its first shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for d, part in _lengths(batch):
                first, own = centres[d]
                home, shards = homes(stacked(part.column("vector")), own, reach, most)
                cols = [*(part.column(c) for c in ("node", "vector", "copies")), pa.array(first + home, pa.int32()), pa.array([(first + s).astype(np.int32) for s in shards], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "vector", "copies", "home", "shards"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, table in grouped(batches, ["shard", "i"]):
        names = table["node"].to_numpy()
        lists = prune(stacked(table["vector"]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([names[own] for own in lists], pa.list_(pa.int64()))], names=["node", "near"])


def _all_pairs(x: np.ndarray, queries: np.ndarray, threshold: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """What ``search`` returns, by comparing every query with every row."""
    hits = [np.nonzero(queries[at : at + block] @ x.T >= threshold - 1e-9) for at in range(0, len(queries), block)]
    return np.concatenate([q + k * block for k, (q, _) in enumerate(hits)]), np.concatenate([r for _, r in hits])


def _both_ways(x: np.ndarray, at: np.ndarray, inside: np.ndarray, ask: np.ndarray, q: np.ndarray, r: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a query, row of a node) of a cell, each once, without pairs of one name: of names (``at``) that are both query and node here,
    those found (``q``, ``r``) in either direction; of all others, whose mirrored pair isn't in this cell, those that an exact comparison finds."""
    n = len(at)
    node, query = np.full(n, -1), np.full(n, -1)
    node[at[inside]], query[at[ask]] = inside, ask
    mirrored = (node[at[q]] >= 0) & (query[at[r]] >= 0)
    codes = [q * n + r, query[at[r[mirrored]]] * n + node[at[q[mirrored]]]]
    for some, other in ((ask[node[at[ask]] < 0], inside), (ask, inside[query[at[inside]] < 0])):
        if len(some) and len(other):
            a, b = _all_pairs(x[other], x[some], threshold)
            codes.append(some[a] * n + other[b])
    q, r = np.divmod(np.unique(np.concatenate(codes)), n)
    keep = at[q] != at[r]
    return q[keep], r[keep]


def _search(threshold: float, exact: bool = False):
    """Cells of nodes (slice i) and queries (home slice j) to (node, links, parent); ``exact``: by comparing all of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, CELL):
            asks = table["asks"].to_numpy(zero_copy_only=False)
            names, vectors, copies = table["node"].to_numpy(), stacked(table["vector"]), table["copies"].to_numpy()
            inside, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(inside) or not len(ask):
                continue
            order = np.argsort(names[inside], kind="stable")
            inside = inside[order]
            own = names[inside]
            if exact:
                q, r = _all_pairs(vectors[inside], vectors[ask], threshold)
            else:
                edges = table["near"].combine_chunks()
                ends = np.concatenate([[0], np.cumsum(edges.value_lengths().fill_null(0).to_numpy())])
                named = edges.flatten().to_numpy()
                at = np.minimum(np.searchsorted(own, named), len(own) - 1)
                at = np.where(own[at] == named, at, -1)
                lists, seeds = ([(a := at[ends[k] : ends[k + 1]])[a >= 0] for k in some.tolist()] for some in (inside, ask))
                # lists of other shards' rows may leave rows out of reach of the medoid here
                _connect(vectors[inside], lists)
                q, r = search(vectors[inside], lists, vectors[ask], threshold, seeds)
            every, at = np.unique(names, return_inverse=True)
            q, r = _both_ways(vectors, at, inside, ask, ask[q], inside[r], threshold)
            keep = np.concatenate([np.einsum("nd,nd->n", vectors[q[k : k + 65536]], vectors[r[k : k + 65536]]) >= threshold for k in range(0, max(1, len(q)), 65536)])
            q, r = q[keep], r[keep]
            # pairs whose mirrored pair no cell has: the query isn't in the home of the node
            home, shards = table["home"].to_numpy().astype(np.int64), table["shards"].combine_chunks()
            most = int(home.max()) + 1
            reached = np.repeat(np.arange(len(names)), shards.value_lengths().fill_null(0).to_numpy()) * most
            flat = shards.flatten().to_numpy().astype(np.int64)
            reached = (reached + flat)[flat < most]
            alone = ~np.isin(q * most + home[r], reached)
            # one parent for each name in the cell
            root = every[roots(len(every), (at[q], at[r]))]
            links = np.zeros(len(every), np.int64)
            np.add.at(links, at[q], copies[r])
            np.add.at(links, at[r[alone]], copies[q[alone]])
            touched = np.unique(np.concatenate([at[q], at[r]]))
            yield pa.RecordBatch.from_arrays([pa.array(every[touched], pa.int64()), pa.array(links[touched], pa.int64()), pa.array(root[touched], pa.int64())], names=["node", "links", "parent"])

    return run


def _connect(x: np.ndarray, lists: list[np.ndarray]) -> None:
    seen, start = np.zeros(len(x), bool), medoid(x)
    while True:
        front = np.array([start])
        seen[start] = True
        while len(front):
            near = np.unique(np.concatenate([lists[a] for a in front.tolist()]))
            front = near[~seen[near]]
            seen[front] = True
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return
        inside = np.flatnonzero(seen)
        start = int(rest[0])
        best = int(inside[(x[inside] @ x[start]).argmax()])
        lists[best] = np.append(lists[best], start)


def _count_links(threshold: float, asked: dict[int, tuple[np.ndarray, np.ndarray]]):
    """``asked``: names and vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(names), np.int64) for d, (names, _) in asked.items()}
        for batch in small(batches):
            for d, part in _lengths(batch):
                if d not in asked:
                    continue
                names, queries = asked[d]
                own, copies, x = part.column("node").to_numpy(), part.column("copies").to_numpy(), stacked(part.column("vector"))
                for at in range(0, len(own), 2048):
                    near = queries @ x[at : at + 2048].T >= threshold
                    near &= names[:, None] != own[None, at : at + 2048]
                    total[d] += near @ copies[at : at + 2048]
        for d, (names, _) in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(total[d], pa.int64())], names=["node", "links"])

    return run


def audit(nodes: DataFrame, found: DataFrame, threshold: float, most: int = 4096) -> float:
    """The least recall of ``found`` (node, links) among the rows asked, against a comparison with all nodes: of the summed
    links, the mean over rows that have links, and the same mean for each class of link counts (powers of two).
    ``nodes`` (node, vector, copies, asked) say how many rows of each are asked; all of them are, in passes of about ``most`` nodes."""
    asked = nodes.where("asked > 0").select("node", "asked")
    held = materialize(asked.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left"))
    passes = -(-held.count() // most)
    total: dict[int, np.ndarray] = {}
    for k in range(passes):
        some = nodes.where(F.expr(f"asked > 0 and pmod(xxhash64('audit', node), {passes}) = {k}")).select("node", "vector").toArrow()
        if not len(some):
            continue
        held_by = {d: (part.column("node").to_numpy(), stacked(part.column("vector"))) for d, part in _lengths(some.combine_chunks().to_batches()[0])}
        exact = nodes.mapInArrow(_count_links(threshold, held_by), "node long, links long").groupBy("node").agg(F.sum("links").alias("exact"))
        both = exact.where("exact > 0").join(held, "node").withColumn("got", F.least("exact", F.coalesce("links", F.lit(0))))
        sums = both.groupBy(F.expr("int(floor(log2(exact)))").alias("class")).agg(*(F.expr(f"double(sum(asked * {x}))") for x in ("exact", "got", "(got / exact)", "1")))
        for c, *row in sums.collect():
            total[c] = total.get(c, 0) + np.array(row)
    if not total:
        return 1.0
    links, got, shares, rows = sum(total.values())
    return float(min(got / links, shares / rows, *(t[2] / t[3] for t in total.values())))


def link(nodes: DataFrame, threshold: float, cell: int, slack: float, sample: int, most_centres: int, most: int | None = None, exact: bool = False) -> DataFrame:
    """(node, links, parent) of ``nodes`` (node, vector, copies): one graph over overlapping shards, built and searched, or with ``exact`` all cells
    compared. Vectors of each length have centres of their own; a node goes to at most ``most`` shards."""
    sizes = {r.d: r.n for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    rate = min(1.0, sample / max(1, sum(sizes.values())))
    picked = nodes.where(F.pmod(F.xxhash64(F.lit("centres"), "node"), F.lit(1 << 30)) < int((1 << 30) * rate)).select("node", "vector").toArrow().sort_by("node").combine_chunks()
    some = {d: stacked(part.column("vector")) for d, part in _lengths(picked.to_batches()[0])} if len(picked) else {}
    centres, first = {}, 0
    for d, n in sorted(sizes.items()):
        own = some.get(d, np.zeros((1, d)))
        centres[d] = first, fit_centres(own, min(len(own), most_centres, max(1, n * (most or 4) // (cell // 2) if n > cell else 1)))
        first += len(centres[d][1])
    reach = slack * float(np.sqrt(2 - 2 * threshold))
    placed = materialize(nodes.mapInArrow(_assign(centres, reach, most), "node long, vector array<double>, copies long, home int, shards array<int>"))
    inside = placed.select("node", "vector", "copies", "home", F.explode("shards").alias("shard"))
    asking = placed.select("node", "vector", "copies", "home", "shards", F.col("home").alias("shard"))
    # how many slices a shard's nodes and its queries fill: a row for each centre
    count = lambda df, name: df.groupBy("shard").agg(F.expr(f"int(ceil(count(*) / {cell}))").alias(name))
    sizes = count(inside, "gi").join(count(asking, "gj"), "shard")
    sliced = inside.join(F.broadcast(sizes), "shard").withColumn("i", F.expr("int(pmod(xxhash64(node, shard), gi))"))
    graph = sliced.select("shard", "i", "node", "vector").repartition("shard", "i").sortWithinPartitions("shard", "i").mapInArrow(_build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    every = lambda g: F.explode(F.expr(f"sequence(0, {g} - 1)"))
    rows = sliced.join(united, "node").select("shard", "i", every("gj").alias("j"), F.lit(False).alias("asks"), "node", "vector", "copies", "home", F.lit(None).cast("array<int>").alias("shards"), "near")
    queries = asking.join(united, "node").join(F.broadcast(sizes), "shard").withColumn("j", F.expr("int(pmod(xxhash64(node, shard), gj))"))
    queries = queries.select("shard", every("gi").alias("i"), "j", F.lit(True).alias("asks"), "node", "vector", "copies", "home", "shards", "near")
    cells = rows.unionByName(queries).repartition(*CELL).sortWithinPartitions(*CELL)
    return materialize(cells.mapInArrow(_search(threshold, exact), "node long, links long, parent long"))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, cell: int = 1500, recall: float = 0.99, slack: float = 0.45, most: int = 4, sample: int = 40_000, most_centres: int = 4096) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links: other rows with a cosine of ``threshold`` or more, equal vectors included. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing; so do rows with a null vec_id (component_id null, kept true). Vectors of
    different lengths are not compared. Very large and very small components are scaled by the largest first. Repeated rows are
    equal vectors. Ties don't matter: a component is named by its smallest vec_id. Centres are fitted on about ``sample``
    rows; every row is in the graph. Other columns are ignored; no rows give none.

    The first graph has each node in at most ``most`` shards; if its audit falls short, further ones have more, then all
    within the linking distance.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    good = "vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    everyone = own.withColumn("good", F.coalesce(F.expr(good), F.lit(False))).withColumn("largest", F.expr("if(good, array_max(transform(vector, x -> abs(x))), null)"))
    everyone = everyone.withColumn("vector", F.expr("if(largest between 1e-100 and 1e100, vector, transform(vector, x -> x / largest))"))
    keyed = everyone.withColumn("key", F.when(F.col("good"), F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256)))
    named = keyed.where("good").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.expr("count_if(vec_id % 100 = 0)").alias("asked"), F.min("vector").alias("vector"))
    # nodes go by their smallest vec_id; where a vec_id repeats with other vectors, by their key
    twice = named.groupBy("vec_id").agg(F.count("*").alias("names"))
    nodes = materialize(named.join(twice, "vec_id").withColumn("node", F.when(F.col("names") == 1, F.col("vec_id")).otherwise(F.xxhash64("key"))).drop("names"))
    exact = False
    while True:
        found = link(nodes.select("node", "vector", "copies"), threshold, cell, slack, sample, most_centres, most, exact)
        if (share := audit(nodes, found, threshold)) >= recall:
            break
        if exact:
            raise RuntimeError(f"recall {share} of exact cells is below {recall}")
        slack, most, exact = min(1.0, slack * 1.6), (most * 4 if most and slack * 1.6 < 1 else None), slack >= 1 and most is None
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    reach = reach.join(nodes.select("node", "vec_id"), "node")
    least = reach.groupBy("component").agg(F.min("vec_id").alias("least"))
    placed = nodes.join(reach.select("node", "component").join(least, "component"), "node", "left").join(links, "node", "left")
    placed = placed.select("key", F.coalesce("least", "vec_id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = keyed.select("vec_id", "key").join(placed, "key", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
