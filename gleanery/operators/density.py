"""Density clusters: topics with outliers and membership probabilities from vectors of any number.

Equal vectors become one weighted node. Nodes are dealt to overlapping cells of bounded size; within a cell the distance to the
``min_samples``-th neighbour (core distance) and a minimum spanning tree of mutual reachability (the largest of two core
distances and the distance between) are exact. The cells' trees together are merged from the lightest edge on, in
blocks of bounded size that one task each takes, into a condensed tree of clusters, of which the most stable
ones are chosen. With one cell the result is that of the complete graph; with more, nodes that share no cell are linked through others only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.sampling import row_ids
from gleanery.sources.scratch import materialize

OUTLIER = -1
#: Distances below this count as this: the density of equal vectors stays finite.
FLOOR = 1e-6
DEEPEST = 40
BRANCH = 16
STATE = {"size": "long", "cluster": "long", "total": "double", "death": "double", "inner": "double", "nodes": "array<long>", "weights": "array<long>"}
STATE_FIELDS = list(STATE)
MERGED = f"kind string, comp long, {', '.join(f'{n} {t}' for n, t in STATE.items())}, old long, parent long, best boolean"
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_MERGED = pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in MERGED.split(", "))])


def unit(vector: Column) -> Column:
    """``vector`` at length 1; null where it is null, empty or zero or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (size > 0) & (size < float("inf"))
    return F.when(good, F.transform(v, lambda x: x / size))


def _nearest(slack: float):
    """The two nearest of the centres that each row brings along (end to end), and whether the border between them is within ``slack``; ties go to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            m = batch.num_rows
            v = batch.column("v").flatten().to_numpy().reshape(m, -1)
            sizes = batch.column("centres").value_lengths().to_numpy() // v.shape[1]
            held = np.arange(max(sizes.max(), 2)) < sizes[:, None]
            c = np.full((*held.shape, v.shape[1]), np.inf)
            c[held] = batch.column("centres").flatten().to_numpy().reshape(-1, v.shape[1])
            d = np.square(v[:, None] - c).sum(axis=2)
            near, row = np.argsort(d, axis=1, kind="stable")[:, :2], np.arange(m)
            one, two = near[:, 0], near[:, 1]
            other = held[row, two]
            between = np.zeros(m)
            between[other] = np.sqrt(np.square(c[row, one][other] - c[row, two][other]).sum(axis=1))
            close = np.zeros(m, bool)
            close[other] = d[row, two][other] - d[row, one][other] <= 2 * slack * between[other]
            columns = [batch.column(n) for n in ("cell", "node", "weight", "v", "spare")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(close)], names=["cell", "node", "weight", "v", "spare", "one", "two", "close"])

    return run


def deal(nodes: DataFrame, cell: int, spare: int, slack: float) -> DataFrame:
    """(cell, node, weight, v): every node in a home cell and, near a border, in up to ``spare`` more; no cell over ``cell`` nodes.

    A cell that is too large is split around BRANCH of its nodes, taken by hash. A node goes to the nearest and, if it has copies left and
    the border is within ``slack``, to the second nearest too. Cells differ in nodes, so splitting ends; after DEEPEST rounds it raises."""
    now, parts = nodes.select(F.lit("").alias("cell"), "node", "weight", "v", F.lit(spare).alias("spare")), []
    for level in range(DEEPEST):
        sizes = materialize(now.groupBy("cell").agg(F.count("*").alias("n")))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= cell:
            parts.append(now)
            break
        sized = now.join(sizes, "cell")
        parts.append(sized.where(F.col("n") <= cell).drop("n"))
        large = sized.where(F.col("n") > cell)
        order = F.xxhash64(F.lit(level), "node")
        picked = large.where(F.pmod(order, F.lit(1 << 30)) * F.col("n") < float(4 * BRANCH << 30)).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(order.alias("h"), "v"))).alias("c"))
        centres = materialize(picked.select("cell", F.flatten(F.transform(F.slice("c", 1, BRANCH), lambda x: x["v"])).alias("centres")))
        placed = large.join(centres, "cell").select("cell", "node", "weight", "v", "spare", "centres").mapInArrow(_nearest(slack), "cell string, node long, weight long, v array<double>, spare int, one int, two int, close boolean")
        both = (F.col("spare") > 0) & F.col("close")
        left = F.col("spare") - 1
        other = F.floor(left / 2).cast("int")
        name = lambda i: F.concat_ws(".", "cell", i.cast("string"))
        home = F.struct(name(F.col("one")).alias("cell"), F.when(both, left - other).otherwise(F.col("spare")).alias("spare"))
        second = F.struct(name(F.col("two")).alias("cell"), other.alias("spare"))
        now = materialize(placed.withColumn("to", F.explode(F.when(both, F.array(home, second)).otherwise(F.array(home)))).select("to.cell", "node", "weight", "v", "to.spare"))
    else:
        raise RuntimeError(f"a cell still has {largest} nodes after {DEEPEST} splits")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return materialize(out.drop("spare"))


def _distances(v: np.ndarray) -> np.ndarray:
    squares = (v * v).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (v @ v.T), 0.0))
    d = np.maximum(d, d.T)
    np.fill_diagonal(d, 0.0)
    return d


def _cores(k: int):
    """Distance of each node of a cell to its k-th other vector, copies counted."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        d, weight = _distances(np.stack(cell["v"])), cell["weight"].to_numpy()
        least = np.argpartition(d, k, axis=1)[:, : k + 1] if k + 1 < len(d) else np.tile(np.arange(len(d)), (len(d), 1))
        at = np.take_along_axis(least, np.take_along_axis(d, least, 1).argsort(axis=1, kind="stable"), 1)
        enough = np.cumsum(weight[at], axis=1) - 1 >= k
        core = np.where(enough.any(axis=1), np.take_along_axis(d, at, 1)[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
        return pd.DataFrame({"node": cell["node"], "core": core})

    return run


def _tree(cell: pd.DataFrame) -> pd.DataFrame:
    """A minimum spanning tree of a cell by mutual reachability, grown node by node."""
    node, core, d = cell["node"].to_numpy(), cell["core"].to_numpy(), _distances(np.stack(cell["v"]))
    m = len(node)
    reach, via, free, edges = np.full(m, np.inf), np.zeros(m, int), np.ones(m, bool), []
    now = 0
    for _ in range(m - 1):
        free[now] = False
        step = np.maximum(np.maximum(d[now], core[now]), core)
        closer = free & (step < reach)
        reach[closer], via[closer] = step[closer], now
        now = int(np.where(free, reach, np.inf).argmin())
        if not np.isfinite(reach[now]):
            break
        edges.append((min(node[now], node[via[now]]), max(node[now], node[via[now]]), reach[now]))
    weight = dict(zip(node.tolist(), cell["weight"].tolist()))
    found = pd.DataFrame(edges, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})
    return found.assign(size_a=found["a"].map(weight).astype("int64"), size_b=found["b"].map(weight).astype("int64"))


def _merge(min_size: int, number: int):
    """Merges the components of a block: the states of those that merged before, then edges sorted by weight; a component without a state is a node of its own.
    All edges of one weight act at once, so the result depends on no order among ties.

    Of what one weight joins: with no cluster so far, ``min_size`` vectors or more become one, and all of them leave it at this density; one
    cluster takes in the rest, which leave it at this density; two or more clusters end and become children of a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a state: size, cluster, total, death, inner, and while there is no cluster the nodes and their weights
        state, up, born = {}, {}, number << 32
        points, ended = ([], [], []), ([], [], [], [])

        def find(x: int) -> int:
            top = x
            while (y := up[top]) != top:
                top = y
            while (y := up[x]) != top:
                up[x], x = top, y
            return top

        def merge(parts: list[int], density: float) -> None:
            nonlocal born
            old, first = [state[p] for p in sorted(parts)], min(parts)
            clusters = [s for s in old if s[1] is not None]
            loose = [s for s in old if s[1] is None]
            size, nodes, weights = sum(s[0] for s in old), [n for s in loose for n in s[5]], [w for s in loose for w in s[6]]
            if not clusters and size < min_size:
                new = [size, None, 0.0, 0.0, 0.0, nodes, weights]
            else:
                if len(clusters) == 1:
                    new = list(clusters[0])
                else:
                    born += 1
                    new = [0, born, 0.0, 0.0, 0.0, [], []]
                    for s in clusters:
                        stability = s[2] - s[0] * density
                        for column, value in zip(ended, (s[1], born, stability >= s[4], s[3])):
                            column.append(value)
                        new[2] += s[0] * density
                        new[4] += max(stability, s[4])
                if loose or len(clusters) != 1:
                    new[3] = max(new[3], density)
                new[0], new[2] = size, new[2] + sum(weights) * density
                points[0].extend(nodes)
                points[1].extend([new[1]] * len(nodes))
                points[2].extend([density] * len(nodes))
            for p in parts:
                up[p] = first
                if p != first:
                    del state[p]
            state[first] = new

        def act(w: float, ends: list[tuple[int, int]]) -> None:
            density = 1.0 / max(w, FLOOR)
            if len(ends) == 1:
                a, b = find(ends[0][0]), find(ends[0][1])
                # within one component an edge changes nothing, unless its vectors are enough for a cluster just now
                if a != b or (state[a][1] is None and state[a][0] >= min_size):
                    merge([a] if a == b else [a, b], density)
                return
            joined, groups = {}, {}

            def head(x: int) -> int:
                while (y := joined.setdefault(x, x)) != x:
                    x = y
                return x

            for a, b in ends:
                a, b = head(find(a)), head(find(b))
                joined[max(a, b)] = min(a, b)
            for x in joined:
                groups.setdefault(head(x), []).append(x)
            for parts in groups.values():
                merge(parts, density)

        w, now = None, []
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in np.flatnonzero(~columns["edge"].to_numpy(zero_copy_only=False)).tolist():
                x = columns["a"][i].as_py()
                up[x], state[x] = x, [columns[n][i].as_py() for n in STATE_FIELDS]
            edges = batch.filter(columns["edge"])
            for weight, a, b, size_a, size_b in zip(*(edges.column(n).to_numpy().tolist() for n in ("w", "a", "b", "size_a", "size_b"))):
                for x, size in ((a, size_a), (b, size_b)):
                    if x not in up:
                        up[x], state[x] = x, [size, None, 0.0, 0.0, 0.0, [x], [size]]
                if weight != w and now:
                    act(w, now)
                    now = []
                w = weight
                now.append((a, b))
        if now:
            act(w, now)

        def rows(kind: str, **columns: list) -> Iterator[pa.RecordBatch]:
            n = len(next(iter(columns.values())))
            for at in range(0, n, 20_000):
                size = min(20_000, n - at)
                values = {"kind": [kind] * size} | {k: v[at : at + size] for k, v in columns.items()}
                yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(size, f.type) for f in _MERGED], schema=_MERGED)

        yield from rows("point", comp=points[0], cluster=points[1], death=points[2])
        yield from rows("cluster", cluster=ended[0], parent=ended[1], best=ended[2], death=ended[3])
        gone = [x for x in up if find(x) != x]
        yield from rows("old", old=gone, comp=[find(x) for x in gone])
        yield from rows("state", comp=list(state), **{n: [s[i] for s in state.values()] for i, n in enumerate(STATE_FIELDS)})

    return run


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        edges = edges.join(names.select(F.col("old").alias(side), "into"), side, "left").withColumn(side, F.coalesce("into", side)).drop("into")
    return edges.where(F.col("own") | (F.col("a") != F.col("b")))


def _latest(states: DataFrame) -> DataFrame:
    """The last state of each component; those of components that have gone may be among them, as no edge names them any more."""
    return states.groupBy("comp").agg(F.max_by(F.struct(*STATE_FIELDS), "number").alias("s"), F.max("number").alias("number")).select("comp", "s.*", "number")


def condense(edges: DataFrame, min_size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Points (node, cluster, density at which it leaves) and clusters (cluster, parent, best, death) of edges (a, b, w, size_a, size_b: the weights of
    the nodes), a node's edge to itself included.

    Blocks follow cuts of the weights, about ``block`` edges each (more if they weigh the same), a task each. Blocks are halved again and again: what the lighter half
    merged is renamed in the heavier one, edges within one component go, and states go on only where an edge names them. So an edge is
    rewritten as often as blocks can be halved, not once for each block before its own."""
    count = edges.count()
    blocks = max(1, -(-count // block))
    cuts = sorted(set(edges.approxQuantile("w", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    shipped, done = np.array(cuts), []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("block", pa.array(np.searchsorted(shipped, batch.column("w").to_numpy(), "left").astype(np.int32)))

    fields = "a long, b long, w double, size_a long, size_b long, own boolean"
    every = edges.withColumn("own", F.col("a") == F.col("b")).select("a", "b", "w", "size_a", "size_b", "own")

    def settle(low: int, high: int, part: DataFrame, states: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(names of components that have gone, states after each block) of the blocks from ``low`` to ``high``."""
        if high - low == 1:
            # an edge's lists are empty, not null: null lists make the rows' way to the task ten times as long
            blank = [(F.array() if t.startswith("array") else F.lit(None)).cast(t).alias(n) for n, t in STATE.items()]
            rows = part.select(F.lit(True).alias("edge"), "w", "a", "b", "size_a", "size_b", *blank)
            if states is not None:
                rows = rows.unionByName(states.select(F.lit(False).alias("edge"), F.col("comp").alias("a"), *STATE_FIELDS), allowMissingColumns=True)
            merged = materialize(rows.repartition(1).sortWithinPartitions("edge", "w", "a", "b").mapInArrow(_merge(min_size, low + 1), MERGED))
            done.append(merged.where("kind in ('point', 'cluster')"))
            return merged.where("kind = 'old'").select("old", F.col("comp").alias("into")), merged.where("kind = 'state'").select("comp", *STATE_FIELDS, F.lit(low).alias("number"))
        middle = (low + high) // 2
        names, after = settle(low, middle, part.where(F.col("block") < middle), states)
        rest = materialize(_renamed(part.where(F.col("block") >= middle), names))
        ends = rest.select(F.col("a").alias("comp")).unionByName(rest.select(F.col("b").alias("comp")))
        known = after if states is None else states.unionByName(after)
        later, last = settle(middle, high, rest, materialize(_latest(known.join(ends, "comp", "left_semi"))))
        onward = names.join(later.select(F.col("old").alias("into"), F.col("into").alias("next")), "into", "left").select("old", F.coalesce("next", "into").alias("into"))
        return materialize(onward.unionByName(later)), after.unionByName(last)

    numbered = materialize(every.mapInArrow(number, f"{fields}, block int")) if cuts else every.withColumn("block", F.lit(0))
    names, states = settle(0, len(cuts) + 1, numbered, None)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # what is left at density 0: several roots are children of the whole, a single one is the whole and no topic
    roots = _latest(states.where("cluster is not null")).join(names.select(F.col("old").alias("comp")), "comp", "left_anti")
    several = roots.limit(2).count() > 1
    top = roots.select("cluster", F.lit(None).cast("long").alias("parent"), (F.lit(several) & (F.col("total") >= F.col("inner"))).alias("best"), "death")
    clusters = found.where("kind = 'cluster'").select("cluster", "parent", "best", "death").unionByName(top)
    return found.where("kind = 'point'").select(F.col("comp").alias("node"), "cluster", F.col("death").alias("density")), materialize(clusters)


def chosen(clusters: DataFrame) -> DataFrame:
    """(cluster, topic): the outermost cluster on the way to the root that is worth more than what it holds; null if there is none. Ways double in length each round."""
    now = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("best"), F.col("cluster")).alias("topic"))
    while now.where("up is not null").limit(1).count():
        far = now.select(F.col("cluster").alias("__c"), F.col("up").alias("__u"), F.col("topic").alias("__t"))
        now = materialize(now.join(far, F.col("up") == F.col("__c"), "left").select("cluster", F.col("__u").alias("up"), F.coalesce("__t", "topic").alias("topic")))
    return now.select("cluster", "topic")


def density_topics(vectors: DataFrame, min_topic_size: int = 10, min_samples: int | None = None, key: str = "vec_id", vector: str = "embedding", cell: int = 2000, spare: int = 3, slack: float = 0.25, block: int = 500_000) -> DataFrame:
    """(key, topic_id, probability) for every row of ``vectors``: topics numbered from 0 by falling size, -1 with probability 0 for outliers.

    Vectors are compared at length 1. ``min_samples`` (default: ``min_topic_size``) others within reach make a vector dense. Probability is the density at which a
    vector leaves its topic over the topic's highest, at most 1. Vectors that are null, empty, zero or not finite are outliers; null and repeated keys stay, a
    row each, and equal vectors have equal answers. Topics of one size are numbered by their smallest vector. One dense whole is no topic: it has nothing to stand out from. No rows give none.
    Groups of equal vectors of any size travel as one node; only rows of vectors with over 1/1000 of all rows get their answer by a broadcast (fewer than 1000 vectors)."""
    k = min_samples or min_topic_size
    rows = materialize(vectors.select(key, unit(F.col(vector)).alias("v")).withColumn("h", F.md5(F.col("v").cast("string").cast("binary"))))
    grouped = rows.where("v is not null").groupBy("h").agg(F.first("v").alias("v"), F.count("*").alias("weight"))
    nodes = materialize(row_ids(grouped, [F.col("v"), F.col("h")], "node"))
    if nodes.isEmpty():
        return rows.select(key, F.lit(OUTLIER).alias("topic_id"), F.lit(0.0).alias("probability"))
    cells = deal(nodes, cell, spare, slack)
    core = materialize(cells.groupBy("cell").applyInPandas(_cores(k), "node long, core double").groupBy("node").agg(F.min("core").alias("core")))
    # a set of equal vectors hangs together from its own core distance on
    own = core.join(nodes.where("weight > 1").select("node", "weight"), "node").where(F.col("core") < float("inf")).select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("core").alias("w"), F.col("weight").alias("size_a"), F.col("weight").alias("size_b"))
    trees = cells.join(core, "node").groupBy("cell").applyInPandas(_tree, "a long, b long, w double, size_a long, size_b long")
    edges = materialize(trees.groupBy("a", "b").agg(F.min("w").alias("w"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b")).unionByName(own))
    points, clusters = condense(edges, min_topic_size, block)
    named = points.join(chosen(clusters), "cluster").where("topic is not null").join(clusters.select(F.col("cluster").alias("topic"), F.col("death").alias("top")), "topic")
    settled = materialize(nodes.select("node", "h", "weight").join(named.select("node", "topic", F.least(F.lit(1.0), F.col("density") / F.col("top")).alias("probability")), "node", "left"))
    sizes = settled.where("topic is not null").groupBy("topic").agg(F.sum("weight").alias("size"), F.min("node").alias("least"))
    numbers = row_ids(sizes, [F.desc("size"), F.col("least")], "number").select("topic", F.col("number").cast("int").alias("topic_id"))
    facts = materialize(settled.join(numbers, "topic", "left").select("h", "weight", F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"), F.coalesce("probability", F.lit(0.0)).alias("probability")))
    total = rows.count()
    heavy, light = facts.where(F.col("weight") * 1000 > total), facts.where(F.col("weight") * 1000 <= total)
    with_vector = rows.where("v is not null").select(key, "h")
    out = with_vector.join(F.broadcast(heavy), "h").unionByName(with_vector.join(F.broadcast(heavy.select("h")), "h", "left_anti").join(light, "h"))
    none = rows.where("v is null").select(key, F.lit(OUTLIER).alias("topic_id"), F.lit(0.0).alias("probability"))
    return out.select(key, "topic_id", "probability").unionByName(none)
