"""One small test for each finding of a review that changed code."""

import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from gleanery.llm import embedding_graph, mixing
from gleanery.operators import adaptation, density, neural, preprocess, sampling, topics
from gleanery.plans import registry
from gleanery.sources import paged


def test_similar_items_name_copies_once(spark):
    tags = {1: "abc", 2: "abc", 3: "abc", 4: "abd", 5: "ab", 6: "cd", 7: "a", 8: "a", 9: "abd", 10: "xyz"}
    rows = spark.createDataFrame([(i, list(t)) for i, t in tags.items()] + [(11, None)], "game_id long, tags array<string>")
    found = [tuple(r) for r in sampling.similar_items(rows).collect()]
    assert len(found) == len(set(found)) == 3 + 3  # members of abc and abd; pairs of abc, abd and ab
    class_of = {b: a for a, b, _, same in found if same}
    paired = {(a, b): n for a, b, n, same in found if not same}
    for x, y in combinations(tags, 2):
        a, b = sorted((class_of.get(x, x), class_of.get(y, y)))
        shared = len(set(tags[x]) & set(tags[y]))
        assert (len(tags[a]) if a == b else paired.get((a, b), 0)) == (shared if shared >= 2 else 0)


def test_topics_are_fitted_on_all_documents(spark):
    """Weights and centres are those of every document, whatever the partitions."""
    words = {0: "planet rocket orbit", 1: "butter flour sugar"}
    rows = [(i, words[i % 2] + (" planet" if i % 4 == 0 else ""), "en", "src0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = docs.select(mixing.under(F.col("lang"), {"en": 1.0}).alias("lang_group"), F.udf(lambda t: mixing.term_counts(t)[1].tolist(), "array<int>")("text").alias("counts"))
    whole = mixing.fit_all(own, 2)
    counts = np.array([mixing.term_counts(r[1])[1] for r in rows])
    assert whole.weight["en"] == pytest.approx(np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1)
    x = np.log1p(counts) * whole.weight["en"]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    at = (x @ whole.centres["en"].T).argmax(axis=1)
    for c, centre in enumerate(whole.centres["en"]):
        mean = x[at == c].sum(axis=0)
        assert centre == pytest.approx(mean / np.sqrt(mean @ mean), abs=1e-5)
    assert len({(i % 2, c) for i, c in enumerate(at)}) == 2
    again = mixing.fit_all(own.repartition(7), 2)
    assert all((whole.centres[k] == again.centres[k]).all() for k in whole.centres)


def test_both_models_are_counted_at_once(spark):
    rows = [(i, f"the loot is {w} and the {w} is loot", 1 if i % 3 else 2) for i in range(30) for w in ("good", "bad")[: 1 + i % 2]] + [(31, None, 1)]
    places = adaptation.contexts(spark.createDataFrame(rows, "review_id long, review_text string, game_id long"), carry=("game_id",))
    assert places.columns == ["review_id", "game_id", "pos", "left", "token", "right"]
    general, held = F.col("game_id") == 2, places.where("review_id % 5 = 0")
    got = {r.model: (r.n, r.perplexity) for r in adaptation.compared(held, places, general).collect()}
    for model, rows in (("before", places.where(general)), ("after", places)):
        want = adaptation.perplexity(held, adaptation.context_counts(rows)).first()
        assert got[model] == (want.n, pytest.approx(want.perplexity))
    assert [tuple(r) for r in adaptation.compared(held.where("false"), places, general).orderBy("model").collect()] == [("after", 0, None), ("before", 0, None)]


def test_game_names_go_without_a_shuffle(spark):
    rows = [(1, "The Witch and the WITCH king", "Witch King 2"), (2, "no title", None), (3, None, "Witch"), (4, " short names stay ", "A 12")]
    got = preprocess.remove_game_names(spark.createDataFrame(rows, "review_id long, review_text string, game_name string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.review_id: r.review_text for r in got.collect()} == {1: "The  and the", 2: "no title", 3: None, 4: " short names stay "}


def test_shards_are_flat_arrays():
    rows = [(0, [3, 1], [1, 2], 1), (0, [5], [1], 0), (1, [2, 3, 4], [1, 1, 1], 1), (1, [], [], 0), (1, [7], [4], 1)]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
    make = lambda part: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=["shard", "slots", "counts", "label"])
    one, two = neural._shards(iter([make(rows[:3]), make(rows[3:])]))
    assert (one.slots.tolist(), one.ends.tolist(), one.labels.tolist()) == ([3, 1, 5], [2, 3], [1, 0])
    assert (two.slots.tolist(), two.ends.tolist(), two.labels.tolist()) == ([2, 3, 4, 7], [3, 4], [1, 1])
    row, slot, weight, label = two.part(1, 9)
    assert (row.tolist(), slot.tolist(), weight.tolist(), label.tolist()) == ([0], [7], [1.0], [1])


def test_blocks_of_any_number_merge_as_one_and_edges_are_not_rewritten_for_each(spark, monkeypatch):
    """points and clusters are those of one block, and tables written grow by a few for each block, whatever the order of the edges."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 400, 900), r.integers(0, 400, 900)
    pairs = sorted({(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y})
    rows = [(x, y, float(np.round(r.random(), 2)) + 0.01, 1 + x % 3, 1 + y % 3) for x, y in pairs]
    df = spark.createDataFrame([*rows, *[(x, x, 0.3, 1 + x % 3, 1 + x % 3) for x in range(0, 400, 7) if x % 3]], "a long, b long, w double, size_a long, size_b long").repartition(2)
    sizes, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda d: sizes.append(1) or real(d))

    def found(block):
        sizes.clear()
        points, clusters = density.condense(df, 8, block)
        members = {}
        for p in points.collect():
            members.setdefault(p.cluster, []).append((p.node, round(p.density, 9)))
        best = {c.cluster: (c.best, round(c.death, 9), c.parent is None) for c in clusters.collect()}
        return sorted((sorted(m), best[c]) for c, m in members.items()), len(sizes)

    whole, _ = found(10_000)
    parts, written = found(150)
    assert parts == whole and written <= 40


def test_shards_are_dealt_once_for_all_epochs(spark, monkeypatch):
    """epochs read shards that were written once, and these go when training ends."""
    rows = spark.range(60).selectExpr("id AS key", "array(cast(id % 7 AS int), cast(7 + id % 5 AS int)) AS slots", "array(1, 1) AS counts", "cast(id % 2 AS int) AS label", "CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 8 THEN 'validation' ELSE 'test' END AS split")
    seen, real = [], neural._epoch
    monkeypatch.setattr(neural, "_epoch", lambda train, *a: (seen.append((train, train.storageLevel.useDisk)), real(train, *a))[1])
    neural.train(rows, hidden=2, epochs=2, shard_rows=20)
    assert len(seen) == 2 and all(stored for _, stored in seen) and not seen[0][0].storageLevel.useDisk


def test_pages_are_handed_on_one_by_one_and_listed_once(spark, tmp_path, monkeypatch):
    """the reader holds a page of texts, not Spark's batch of 10,000 rows, and doesn't list a game's folder again for each page."""
    rows = spark.range(430).selectExpr("'a/b' AS game", "concat('text ', id) AS review_text", "true AS voted_up", "1 AS votes_up", "'english' AS language", "id AS timestamp_created", "cast(id AS string) AS author")
    path = f"file://{tmp_path}/pages"
    paged.write_pages(rows, path, [F.col("timestamp_created")])
    listed, real = [], paged.FolderFeed._pages
    monkeypatch.setattr(paged.FolderFeed, "_pages", lambda self, key: listed.append(key) or real(self, key))
    reader = paged._Reader(paged.FolderFeed(path), {"keys": "a/b", "most": "430", "pause": "0"})
    found = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in found] == [100, 100, 100, 100, 30] and len(listed) <= 2
    assert [x for b in found for x in b.column("author").to_pylist()] == [str(i) for i in range(430)]
    assert list(reader.read(type(reader.partitions()[0])("none"))) == []


def test_terms_are_added_up_in_tasks_and_shuffled_once(spark):
    """F16, F17, F18: rows leave a task added up, steps of any size give equal counts, and one exchange serves topics' sums and those over all topics."""
    rows = [(-1 if i % 3 else i % 4, None if i % 11 == 0 else [] if i % 13 == 0 else ["loot", "loot", "żółw", f"w{i % 7}", f"once {i}"]) for i in range(200)]
    docs = spark.createDataFrame(rows, "topic_id int, terms array<string>").coalesce(1)
    every = [(t, w) for t, ws in rows for w in ws or []]
    held = [(t, w) for t, ws in rows for w in set(ws or [])]
    common = {w for _, w in held if sum(x == w for _, x in held) >= 2}
    want = sorted((t, w, every.count((t, w)), sum(x == w for _, x in every)) for t, w in set(every) if w in common)
    counts = topics.term_counts(docs, F.col("terms"))
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect())) == want
    sums = topics.term_sums(docs, F.col("terms")).collect()
    assert len(sums) == len(set(every)) and sum(r.tf for r in sums) == len(every) and sum(r.df for r in sums) == len(held)
    assert topics.term_sums(docs.where("size(terms) < 1"), F.col("terms")).count() == 0
    docs = spark.range(0, 25_000, 1, 1).selectExpr("cast(id % 2 as int) AS topic_id", "array('loot', 'loot', 'boss') AS terms")
    parts = topics.term_sums(docs, F.col("terms"), 1 << 10)
    assert parts.count() == 3 * 4
    added = parts.groupBy("topic_id", "term").agg(F.sum("tf"), F.sum("df")).collect()
    assert sorted(map(tuple, added)) == [(0, "boss", 12_500, 12_500), (0, "loot", 25_000, 12_500), (1, "boss", 12_500, 12_500), (1, "loot", 25_000, 12_500)]


def test_similar_games_are_all_pairs_copies_too(spark, tmp_path):
    """every two games that share two tags have a row, whatever the size of slices, in the query too; copies of a game are no exception."""
    tags = {1: "abc", 2: "abc", 3: "abc", 4: "abd", 5: "ab", 6: "cd", 7: "a", 8: "a", 9: "abd", 10: "xyz", **{i: "abcx" for i in range(20, 60)}}
    rows = spark.createDataFrame([(i, list(t)) for i, t in tags.items()] + [(11, None)], "game_id long, tags array<string>")
    want = sorted((a, b, n) for a, b in combinations(sorted(tags), 2) if (n := len(set(tags[a]) & set(tags[b]))) >= 2)
    for size in (3, 512):
        assert sorted(map(tuple, sampling.similar_pairs(rows, slice_size=size).collect())) == want
    parts = [(i, "red blue", "B1", "TIN", 1 + i % 2) for i in range(1, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    got = registry.QUERIES["j11_similar_games"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got)) == [(a, b, 3 if (b - a) % 2 == 0 else 2) for a, b in combinations(range(1, 7), 2)]


def test_centres_need_no_table_of_their_square(spark):
    """neither the fit on the driver nor what it ships grows with rows times centres or with the square of the centres; homes and shards are the plain ones."""
    x = embedding_graph.unit(np.random.default_rng(3).normal(size=(12_000, 8)))
    tracemalloc.start()
    centres = embedding_graph.fit_centres(x, 1500, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert len(CloudPickleSerializer().dumps(embedding_graph._assign({8: (0, centres)}, 0.1, 4))) < 1 << 20
    some, few = x[:1500], centres[:40]
    home, shards = embedding_graph.homes(some, few, 0.1, step=64)
    far = ((some[:, None] - few) ** 2).sum(axis=2)
    assert (home == far.argmin(axis=1)).all()
    for i in range(0, 1500, 50):
        gap = np.sqrt(((few - few[home[i]]) ** 2).sum(axis=1))
        near = [c for c in range(40) if c == home[i] or (far[i, c] - far[i, home[i]]) / (2 * gap[c]) <= 0.1]
        assert shards[i].tolist() == near


def test_only_contexts_that_are_asked_for_leave_their_tasks(spark, monkeypatch):
    """tables written for masked tokens don't hold the contexts of the whole corpus; a table of slots that tells nothing apart and steps of any size give equal results."""
    r = np.random.default_rng(8)
    words = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(60)]
    rows = [(i, " ".join(words[x] for x in r.integers(0, 60, 40)), [None, 1, 2][i % 3]) for i in range(200)]
    places = adaptation.contexts(spark.createDataFrame(rows, "review_id long, review_text string, game_id long"), carry=("game_id",))
    held, general = places.where("review_id < 10 and pos % 20 = 3"), F.col("game_id") == 2
    sizes, real = [], adaptation.materialize
    monkeypatch.setattr(adaptation, "materialize", lambda d: (sizes.append((out := real(d)).count()), out)[1])
    found = lambda: {x.model: (x.n, round(x.perplexity, 9)) for x in adaptation.compared(held, places, general).collect()}
    want = {m: adaptation.perplexity(held, adaptation.context_counts(own)).first() for m, own in (("before", places.where(general)), ("after", places))}
    assert found() == {m: (x.n, round(x.perplexity, 9)) for m, x in want.items()}
    assert places.select("left", "token", "right").distinct().count() > 7000 and max(sizes) < 400
    sums = adaptation.level_sums
    monkeypatch.setattr(adaptation, "asked_slots", lambda asked: np.full(1 << 16, 255, np.uint8))
    monkeypatch.setattr(adaptation, "level_sums", lambda learned, table: sums(learned.repartition(3), table, 1 << 10))
    assert found() == {m: (x.n, round(x.perplexity, 9)) for m, x in want.items()} and max(sizes) > 7000


def test_edges_reach_their_block_without_null_lists(spark, monkeypatch):
    """Spark takes ten times as long to hand rows with null lists to a task; edges bring empty ones, and points are the same, edges within one component or not."""
    rows = [(i, j, 0.1 + 0.01 * (i // 20) + 0.001 * (j - i), 1, 1) for i in range(60) for j in range(i + 1, min(i + 4, 60)) if i // 20 == j // 20]
    tree = [r for r in rows if r[1] - r[0] == 1]
    plans, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), real(d))[1])
    schema = "a long, b long, w double, size_a long, size_b long"
    found = lambda own, block: sorted((p.node, p.density) for p in density.condense(spark.createDataFrame(own, schema), 5, block)[0].collect())
    assert found(rows, 1000) == found(tree, 1000) == found(rows, 30) and len(found(rows, 1000)) == 60
    fed = [p for p in plans if "AS nodes" in p]
    assert fed and not any("null AS nodes" in p or "null AS weights" in p for p in fed)
