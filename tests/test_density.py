"""Density topics against a tree cut from the top over the complete graph."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import density


def by_hand(x, m, k):
    """Labels and probabilities of unit vectors: components at falling distances, from the whole down."""
    n = len(x)
    d = density._distances(x)
    core = np.sort(d, axis=1)[:, min(k, n - 1)] if n > k else np.full(n, np.inf)
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    np.fill_diagonal(reach, 0.0)

    def parts(rows, limit):  # components of edges lighter than limit
        left, out = set(rows), []
        while left:
            todo, comp = [min(left)], set()
            while todo:
                i = todo.pop()
                if i in comp:
                    continue
                comp.add(i)
                todo += [j for j in left if j not in comp and j != i and reach[i, j] < limit]
            left -= comp
            out.append(sorted(comp))
        return out

    leave, clusters = {}, []

    def grow(rows, birth, parent):
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "size": len(rows), "total": 0.0, "death": 0.0, "rows": list(rows), "kids": []})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        now = list(rows)
        while now:
            inner = reach[np.ix_(now, now)]
            limit = top_edge(now, inner)
            lam = 1 / max(limit, density.FLOOR)
            pieces = parts(now, limit)
            big = [p for p in pieces if len(p) >= m]
            small = [i for p in pieces if len(p) < m for i in p]
            clusters[me]["death"] = max(clusters[me]["death"], lam) if small or len(big) != 1 else clusters[me]["death"]
            clusters[me]["total"] += lam * len(small)
            for i in small:
                leave[i] = (me, lam)
            if len(big) == 1:
                now = big[0]
                continue
            for p in big:
                clusters[me]["total"] += lam * len(p)
            for p in big:
                grow(p, lam, me)
            return

    def top_edge(rows, inner):
        """The heaviest edge of a spanning tree: the smallest limit at which all hang together."""
        seen, dist = {0}, inner[0].copy()
        worst = 0.0
        while len(seen) < len(rows):
            j = min((i for i in range(len(rows)) if i not in seen), key=lambda i: dist[i])
            worst = max(worst, dist[j])
            seen.add(j)
            dist = np.minimum(dist, inner[j])
        return worst

    label, prob = np.full(n, -1), np.zeros(n)
    if n >= m and np.isfinite(core).all():
        grow(list(range(n)), 0.0, None)

        def best(c):
            own = clusters[c]["total"] - clusters[c]["size"] * clusters[c]["birth"]
            below = [best(kid) for kid in clusters[c]["kids"]]
            inner = sum(b[0] for b in below)
            return (own, [c]) if own >= inner and c else (max(inner, 0.0) if c else inner, [t for b in below for t in b[1]])

        picked = best(0)[1]
        for i, (c, lam) in leave.items():
            while c is not None and c not in picked:
                c = clusters[c]["parent"]
            if c is not None:
                label[i], prob[i] = c, min(1.0, lam / clusters[c]["death"])
    return label, prob


def blobs(seed, sizes, noise=40, d=8, spread=0.05):
    r = np.random.default_rng(seed)
    x = [r.normal(size=d) + 0 * r.normal() for _ in sizes]
    rows = [c / np.linalg.norm(c) + spread * r.normal(size=d) * (1 + i) / 2 for i, (c, s) in enumerate(zip(x, sizes)) for _ in range(s)]
    return np.array(rows + [v for v in r.normal(size=(noise, d))])


def same_partition(a, b):
    pairs = Counter(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in pairs)


@pytest.mark.parametrize("seed,m,block", [(0, 10, 200_000), (1, 10, 40), (2, 20, 25), (3, 5, 60)])
def test_density_topics_equal_the_complete_graph(spark, seed, m, block):
    x = blobs(seed, [30, 45, 24, 15])
    x = np.vstack([x, x[:3], x[:3], x[:1].repeat(25, axis=0), x[40:41].repeat(m, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in density.density_topics(df, m, block=block).collect()}
    label, prob = by_hand(np.array([v / np.linalg.norm(v) for v in x]), m, m)
    mine = [got[i].topic_id for i in range(len(x))]
    assert same_partition(mine, label.tolist()), list(zip(mine, label))
    assert np.allclose([got[i].probability for i in range(len(x))], prob, atol=1e-6)
    sizes = Counter(t for t in mine if t >= 0)
    assert len(sizes) > 1 and sorted(sizes) == list(range(len(sizes))) and min(sizes.values()) >= m
    assert all(sizes[t] >= sizes[t + 1] for t in range(len(sizes) - 1))


def test_cells_are_bounded_and_topics_hold_across_borders(spark):
    """Many cells: tight groups stay whole though they are cut by borders, no cell is too large, every node has a home."""
    x = blobs(7, [60, 50, 40, 40, 30], noise=300, spread=0.02)
    nodes = spark.createDataFrame([(i, 1, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "node long, weight long, v array<double>")
    cells = density.deal(nodes, 70, 3, 0.25).collect()
    size = Counter(r.cell for r in cells)
    assert max(size.values()) <= 70 and len(size) > 8 and {r.node for r in cells} == set(range(len(x))) and max(Counter(r.node for r in cells).values()) <= 4
    assert len(cells) == len({(r.cell, r.node) for r in cells})
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.topic_id for r in density.density_topics(df, 10, cell=70, block=100).collect()}
    at = 0
    for s in (60, 50, 40, 40, 30):
        own = Counter(got[i] for i in range(at, at + s))
        assert own.most_common(1)[0][0] != -1 and own.most_common(1)[0][1] >= 0.9 * s
        at += s
    assert sum(got[i] == -1 for i in range(at, len(x))) > 150


def test_density_topics_of_odd_rows(spark):
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in data], "vec_id long, embedding array<double>, topic_id int")
    assert Counter(tuple(r) for r in density.density_topics(df, 2).collect()) == Counter((i, -1, 0.0) for i, _ in data)
    assert density.density_topics(df.where("false")).collect() == []
    copies = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding"))
    assert {(r.topic_id, r.probability) for r in density.density_topics(copies, 10).collect()} == {(0, 1.0), (1, 1.0)}
