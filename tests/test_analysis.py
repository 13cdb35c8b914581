"""Evaluation, sampling, experiments, topics, time, sources and streams on small cases and by properties."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gleanery.functions import stats
from gleanery.operators import evaluation as E
from gleanery.operators import experiments as X
from gleanery.operators import models, quality, sampling, topics
from gleanery.operators import timeseries as D
from gleanery.plans.queries_sampling import part_games
from gleanery.sources import paged
from gleanery.sources import reviews as R
from gleanery.streaming import ingest


def pairs(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "label int, pred_a int")


@pytest.mark.parametrize(
    "truth,pred,accuracy,f1",
    [([1, 0, 1, 0], [1, 0, 1, 0], 1.0, 1.0), ([1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [1, 1, 1, 1, 0, 0, 0, 0, 0, 1], 0.8, 0.8), ([1] * 7 + [0] * 3, [1] * 6 + [0, 0, 0, 1], 0.8, 6 / 7), ([1, 0], [0, 1], 0.0, 0.0), ([1, 1], [1, 1], 1.0, 1.0)],
)
def test_metrics(spark, truth, pred, accuracy, f1):
    r = E.metrics(pairs(spark, truth, pred)).first()
    assert (r.accuracy, r.f1) == pytest.approx((accuracy, f1)) and r.tn + r.fp + r.fn + r.tp == len(truth)


def test_metrics_need_rows(spark):
    with pytest.raises(ValueError):
        E.check_rows(pairs(spark, [], []))


def test_per_class(spark):
    got = {r["class"]: (r.correct, r.total, r.accuracy) for r in E.per_class(pairs(spark, [1, 1, 0, 0], [1, 0, 0, 0])).collect()}
    assert got == {"positive": (1, 2, 0.5), "negative": (2, 2, 1.0)}
    assert E.per_class(pairs(spark, [1], [1])).where("class = 'negative'").first().accuracy == 0.0


def test_grades(spark):
    df = spark.createDataFrame([(0.9, 0.86), (0.9, 0.7), (0.87, 0.9), (0.5, 0.5)], "a double, b double")
    got = [tuple(r) for r in df.select(E.grade(F.col("a"), "english"), E.grade(F.col("b"), "japanese"), E.recommendation(F.col("a"), F.col("b")), E.validation_verdict(F.col("a"))).collect()]
    assert got == [("excellent", "excellent", "either", "pass"), ("excellent", "poor", "english", "pass"), ("good", "excellent", "review", "tolerable"), ("poor", "poor", "investigate", "fail")]
    with pytest.raises(ValueError):
        E.grade(F.lit(1.0), "klingon")


def test_mcnemar_p_is_exact(spark):
    cases = [(0, 0), (5, 0), (0, 9), (17, 20), (60, 31), (1500, 1400), (3, 3)]
    got = [r.p for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, b long").select("i", stats.mcnemar_p(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()]
    for (a, b), p in zip(cases, got):
        n = a + b
        exact = min(Fraction(1), 2 * Fraction(sum(math.comb(n, i) for i in range(min(a, b) + 1)), 2**n)) if n else 1
        assert p == pytest.approx(float(exact), rel=1e-8)


def test_p_values():
    assert stats.t_test_p(2.0, 11) == pytest.approx(0.07338803477074039, rel=1e-9)
    assert stats.t_test_p(0.0, 5) == pytest.approx(1.0) and stats.t_test_p(None, 1) is None
    assert stats.wilcoxon_p(3, 6) == pytest.approx(10 / 64) and stats.wilcoxon_p(0, 5) == pytest.approx(2 / 32)
    assert stats.wilcoxon_p(None, 0) is None and 0 < stats.wilcoxon_p(200.0, 60) < 1e-3


def test_student_p_as_a_column(spark):
    cases = [(t, n) for n in (2, 3, 4, 5, 6, 20, 41, 1999, 2000, 2001, 2002, 50_000, 10**7) for t in (0.0, 0.3, -1.0, 2.5, 9.0)]
    got = spark.createDataFrame(cases, "t double, n long").select("t", "n", stats.student_p(F.col("t"), F.col("n")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(stats.t_test_p(r.t, r.n), abs=1e-9 if r.n < 10**6 else 1e-8), r  # the continued fraction itself loses digits at 10^7
    odd = spark.createDataFrame([(None, 5), (1.0, 1), (1.0, 0)], "t double, n long").select(stats.student_p(F.col("t"), F.col("n")).alias("p"))
    assert [r.p for r in odd.collect()] == [None] * 3


def test_paired_t_by_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", 1.0), ("c", 1.0), (None, 1.0), (None, -1.0), ("d", None)]
    got = {r.g: (r.n, r.t, r.p) for r in X.paired_t(spark.createDataFrame(rows, "g string, diff double"), ["g"]).collect()}
    t = (7 / 3) / (math.sqrt(sum((x - 7 / 3) ** 2 for x in (1, 2, 4)) / 2) / math.sqrt(3))
    assert got["a"] == pytest.approx((3, t, stats.t_test_p(t, 3))) and got[None] == pytest.approx((2, 0.0, 1.0))
    assert got["b"] == (1, None, None) and got["c"] == (2, None, None) and got["d"] == (0, None, None)


def test_json_lists(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'say "{i}"\n[x]') for i in range(25)]
    path = str(tmp_path / "lists")
    R.write_json_lists(spark.createDataFrame(rows, "id int, review_text string"), path, F.floor(F.col("id") / 10))
    assert sorted(spark.read.text(path).select(F.expr("json_array_length(value)")).toPandas().iloc[:, 0]) == [5, 10, 10]
    assert sorted(map(tuple, R.read_json(spark, path, "id int, review_text string", multi_line=False).collect())) == rows


@pytest.mark.parametrize("most", [3, 1 << 17])
def test_gram_counts(spark, most):
    rows = [("en", "The the"), ("en", ""), ("en", "ab"), ("de", "Äpfel 🍎🍎🍎"), ("de", "x" * 5000), ("en", "The the")]
    want = Counter((k, t[i : i + 3].lower()) for k, t in rows for i in range(max(len(t) - 2, 1)))
    got = quality.gram_counts(spark.createDataFrame(rows, "language string, text string"), "text", "language", 3, most).collect()
    assert {(r.language, r.gram): r.c for r in got} == want and len(got) == len(want)
    assert quality.gram_counts(spark.createDataFrame([], "language string, text string"), "text", "language", 3).count() == 0


def test_topics_of_reviews_without_a_vector(spark, sf_dir):
    """A review takes its vector's topic; one without a vector is an outlier."""
    own = spark.createDataFrame([(0,), (10**9,), (None,)], "review_id long")
    given = {r.vec_id: r.label for r in R.table(spark, sf_dir, "embeddings").collect()}
    got = {r.review_id: r.topic_id for r in R.topical(own, spark, sf_dir).collect()}
    assert got == {0: given[0], 10**9: -1, None: -1}


def test_softmax(spark):
    r = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "x array<double>").select(stats.softmax(F.col("x")).alias("p"), stats.argmax(F.col("x")).alias("k")).first()
    assert r.p == pytest.approx([0.5, 0.5, 0.0]) and r.k == 0


def test_signed_ranks(spark):
    df = spark.createDataFrame([(d,) for d in (1.0, -1.0, 2.0, 0.0, -3.0, 5.0)], "diff double")
    assert tuple(X.signed_ranks(df).first()) == (5, 1.5 + 3 + 5, 1.5 + 4, True, 5.5)
    assert X.signed_ranks(df.where("diff = 0")).first().n == 0


def labelled(spark, n1, n0):
    return spark.createDataFrame([(i, 1 if i < n1 else 0) for i in range(n1 + n0)], "review_id int, label int")


def test_balanced(spark):
    counts = lambda df: {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert counts(sampling.balanced(labelled(spark, 10, 5))) == {1: 5, 0: 5}
    assert counts(sampling.balanced(labelled(spark, 10, 10), 5)) == {1: 5, 0: 5}
    assert sampling.balanced(labelled(spark, 0, 0)).count() == 0


@pytest.mark.parametrize("order", ["test_first", "train_first"])
def test_split(spark, order):
    df = sampling.stratified_split(labelled(spark, 83, 41), order=order)
    rows = df.collect()
    assert len({r.review_id for r in rows}) == len(rows) == 124
    for label, n in ((1, 83), (0, 41)):
        size = {s: sum(r.split == s and r.label == label for r in rows) for s in ("train", "validation", "test")}
        assert abs(size["test"] - 0.15 * n) <= 1 and abs(size["validation"] - 0.15 * n) <= 1.2 and sum(size.values()) == n
    assert {r.review_id: r.split for r in sampling.stratified_split(labelled(spark, 83, 41).repartition(5), order=order).collect()} == {r.review_id: r.split for r in rows}


def test_split_arguments(spark):
    with pytest.raises(ValueError):
        sampling.stratified_split(labelled(spark, 2, 2), (0.5, 0.4, 0.2))
    with pytest.raises(ValueError):
        sampling.stratified_split(labelled(spark, 2, 2).drop("label"))


def test_diverse_selection_equals_a_loop(spark, sf_dir):
    candidates = part_games(spark, sf_dir).withColumn("ordinal", (F.col("game_id") * 7919) % 1009)
    kept = []
    for r in sorted(candidates.collect(), key=lambda r: (r.ordinal, r.game_id)):
        genres, tags = frozenset(r.genres), set(r.tags)
        if len(kept) >= 20 or not genres or sum(g == genres for _, g, _ in kept) >= 2 or any(sum(x in g for _, g, _ in kept) >= 6 for x in genres) or any(len(tags & t) >= 2 for _, _, t in kept):
            continue
        kept.append((r.game_id, genres, tags))
    assert [r.game_id for r in sampling.select_diverse(candidates).collect()] == [k[0] for k in kept]


def test_early_stopping(spark):
    rows = [("r", e, v) for e, v in enumerate([0.5, 0.6, 0.6, 0.59, 0.55, 0.9], 1)]
    got = X.early_stopping(spark.createDataFrame(rows, "run string, epoch int, val_acc double")).first()
    assert (got.best_epoch, got.stop_epoch) == (2, 5)


def test_run_stats_of_one_run(spark):
    df = spark.createDataFrame([("a", 80.0, None), ("a", 10.0, "failed")], "base string, ood_acc double, error string")
    assert tuple(X.run_stats(df).first()) == ("a", 80.0, 0.0, 80.0, 80.0, 1)


def test_optimal_size(spark):
    df = spark.createDataFrame([(100, 80.0), (100, 95.0), (200, 86.0), (200, 85.0), (300, 99.0)], "data_size int, test_acc double")
    assert tuple(X.optimal_size(df).first()) == (200, "all")
    assert tuple(X.optimal_size(df, target=99.5).first()) == (None, "none")


def test_topic_ranking_without_outliers(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "topic_id int")
    assert [(r.topic_id, r.n_topics) for r in topics.topic_ranking(df).orderBy("rank").collect()] == [(0, 2), (1, 2)]


def test_topic_assignment_invariants(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = topics.assign(vectors, 5, min_size=10).collect()
    assert len(got) == vectors.count()
    sizes = {t: sum(r.topic_id == t for r in got) for t in {r.topic_id for r in got}}
    assert 0 < sizes.get(-1, 0) < len(got)


def test_series_arguments(spark, sf_dir):
    with pytest.raises(ValueError):
        D.sentiment_series(R.labelled(spark, sf_dir), "year")


def test_models(spark, tmp_path):
    r = random.Random(0)
    good, bad = "great love fun amazing best".split(), "terrible hate awful boring worst".split()
    rows = [(i, f"this is {r.choice(good if i % 2 else bad)} i {'love' if i % 2 else 'hate'} it", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "review_id int, review_text string, label int")
    model = models.fit(df)
    scored = models.score(df, model).join(df, "review_id")
    assert scored.where("prediction = label").count() >= 190 and models.calibrate(model, spark)
    model.write().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = models.score(df, PipelineModel.load(str(tmp_path / "m")))
    assert again.select("review_id", "prediction").exceptAll(scored.select("review_id", "prediction")).count() == 0
    assert models.score(df, models.adapted_fit(df.select("review_text"), df)).count() == 200
    assert {r.token for r in models.token_coefficients(model).orderBy(F.desc("coefficient")).limit(3).collect()} & set(good)


def test_model_specs():
    assert models.parse_model_spec("self:a/b") == ("self", "a/b", "b") and models.parse_model_spec("hf:x:y") == ("hf", "x", "y")
    assert models.recommended_model("English") == "count-logistic"
    for wrong in ("zz:a", "self:"):
        with pytest.raises(ValueError):
            models.parse_model_spec(wrong)
    with pytest.raises(ValueError):
        models.recommended_model("latin")


def test_backoff():
    assert paged.backoff_schedule([500, 429, 500]) == [1, 20, 4]
    waits, calls = [], iter([OSError(), OSError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert paged.with_retries(call, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(OSError):
        paged.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
    with pytest.raises(ValueError):
        paged.validate("latin", "all")


def test_paged_source(spark):
    class DemoFeed:
        """A feed without a network: pages of numbered reviews, every fourth too short to keep."""

        def page(self, key: str, cursor: str, size: int):
            start = 0 if cursor == "*" else int(cursor)
            rows = [{"review_text": f"review {i} of game {key}" if i % 4 else "no", "voted_up": i % 2 == 0, "votes_up": i, "language": "english", "timestamp_created": 1704067200 + i, "author": str(i)} for i in range(start, min(start + size, 400))]
            return rows, str(start + size) if start + size < 400 else None

    paged.register(spark, DemoFeed())
    rows = spark.read.format("paged_reviews").options(keys="10,20,30", most="120", min_length="10", language="english", pause="0").load().collect()
    assert {r.game for r in rows} == {"10", "20", "30"} and len(rows) == 360 and all(len(r.review_text) >= 10 for r in rows)


def test_page_tags_of_a_class(spark):
    from gleanery.functions import text as T

    html = '<a href="x">nav</a><a href="y" class="app_tag" style="">\n\tPuzzle &amp; Co\n</a><a class="app_tag"> </a><a class="app_tag">Co-op</a>'
    r = spark.createDataFrame([(html,), (None,)], "html string").select(T.page_tags(F.col("html")).alias("t"), T.page_tags(F.col("html"), None, 2).alias("all")).collect()
    assert r[0].t == ["Puzzle & Co", "Co-op"] and r[0].all == ["nav", "Puzzle & Co"] and r[1].t is None


def test_csv_and_json(spark, tmp_path):
    rows = [("line\nbreak \"quoted\", comma", 1), ("None", 2), ("NA", 3)]
    df = spark.createDataFrame(rows, "review_text string, n int")
    R.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in R.read_csv(spark, str(tmp_path / "c"), "review_text string, n int").collect()) == sorted(rows)
    assert R.read_csv(spark, str(tmp_path / "c"), "review_text string, n int", ("NA", "None")).where("review_text is null").count() == 2
    (tmp_path / "j.json").write_text('[{"review_text": "a", "voted_up": true}, {"review_text": "b"}]')
    assert [(r.review_text, r.voted_up) for r in R.read_json(spark, str(tmp_path / "j.json")).collect()] == [("a", True), ("b", None)]


def test_append_new_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for _ in range(2):
        R.append_new(spark.createDataFrame([("k1", 1), (None, 2)], "key string, v int"), path, "key")
    assert spark.read.parquet(path).count() == 2


def test_snapshots_keep_one_row_a_game_and_day(spark, tmp_path):
    path, kinds = f"file://{tmp_path}/log", "game_id string, taken_at string, players int"
    log = lambda rows: R.append_snapshots(spark.createDataFrame(rows, kinds).withColumn("taken_at", F.to_timestamp("taken_at")), path)
    log([])
    log([("a", "2024-01-01 01:00:00", 5), ("a", "2024-01-01 09:00:00", 7), ("a", "2024-01-01 09:00:00", 8), (None, "2024-01-01 02:00:00", 1), ("b", None, 2)])
    log([("a", "2024-01-01 10:00:00", 9), (None, "2024-01-01 03:00:00", 4), ("b", "2024-01-01 00:00:00", 3), ("a", "2024-01-02 00:00:00", None)])
    got = sorted((r.game_id or "", str(r.day), r.players or 0) for r in spark.read.parquet(path).collect())
    assert got == [("", "2024-01-01", 1), ("a", "2024-01-01", 8), ("a", "2024-01-02", 0), ("b", "2024-01-01", 3)]
    with pytest.raises(ValueError):
        R.append_snapshots(spark.range(1), path)


def test_listed_games_stop_at_the_first_empty_page():
    pages = {1: [{"logo": "x/apps/7/l.jpg", "name": "seven"}, {"logo": "x/none", "name": "no"}, {"name": "bare"}], 2: [{"logo": "/apps/7/", "name": "again"}, {"logo": "/apps/9/"}], 4: [{"logo": "/apps/1/", "name": "late"}]}
    asked = []
    page = lambda n: (asked.append(n), pages.get(n, []))[1]
    assert paged.listed_games(page, pause=0) == [("7", "seven"), ("9", "")] and asked == [1, 2, 3]
    assert paged.listed_games(page, most=1, pause=0) == [("7", "seven")]


def test_splits_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    R.write_splits(df, f"file://{tmp_path}/s")
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/s").collect()) == [(1, "train"), (2, "test"), (3, "train")]
    assert sorted(f.name for f in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    with pytest.raises(ValueError):
        R.write_splits(df.drop("split"), f"file://{tmp_path}/t")


def test_stream_equals_batch_and_drops_copies(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for name, part in (("a", events.where("event_id % 2 = 0")), ("b", events)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    for k, f in enumerate(sorted((tmp_path / "in").glob("*/*.parquet"))):
        (tmp_path / "flat").mkdir(exist_ok=True)
        f.rename(tmp_path / "flat" / f"{k}.parquet")
    stream = ingest.windowed_counts(ingest.read_events(spark, str(tmp_path / "flat")), late="40 days")
    got = ingest.run_to_table(stream, "windows_test", "complete", str(tmp_path / "cp"))
    rows = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert rows(got) == rows(ingest.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_upserts_survive_a_second_run(spark, sf_dir, tmp_path):
    folder = tmp_path / "src"
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.parquet(str(folder))
    for k in range(2):
        ingest.start_upserts(ingest.read_events(spark, str(folder)), f"file://{tmp_path}/out", str(tmp_path / f"cp{k}"), "event_id").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == spark.read.parquet(str(folder)).count()


def test_unseen_columns():
    with pytest.raises(ValueError):
        R.exclusion_list()


def test_as_of_join_equals_a_search(spark):
    import datetime

    t = lambda h: None if h is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    r = random.Random(1)
    left = [(k, r.choice("ab") if r.random() < 0.9 else None, r.randrange(200) if r.random() < 0.95 else None) for k in range(150)]
    right = [(r.choice("abc"), r.randrange(200), r.randrange(9)) for _ in range(40)] + [("a", None, 5), ("b", 7, None)]
    a = spark.createDataFrame([(k, g, t(h)) for k, g, h in left], "id int, g string, ts timestamp")
    b = spark.createDataFrame([(g, t(h), v) for g, h, v in right], "g string, ts timestamp, v int")
    for bucket in ("hour", "day", "year"):
        got = {x.id: x.v for x in D.as_of_join(a, b, ["g"], "ts", ["v"], bucket).collect()}
        for k, g, h in left:
            seen = [(x, v is not None, v) for y, x, v in right if y == g and x is not None and h is not None and x <= h]
            assert got[k] == (max(seen)[2] if seen else None), (bucket, k)
    assert len(got) == 150 and D.as_of_join(a.where("false"), b, ["g"], "ts", ["v"]).count() == 0


def test_lag_correlation_finds_the_lead(spark):
    import datetime

    r = random.Random(3)
    base = [r.random() for _ in range(60)]
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [("x", day(k), base[k], base[k - 3] if k >= 3 else 0.5) for k in range(60)] + [("flat", day(k), 1.0, float(k)) for k in range(9)]
    got = {(x.g, x.lag): x for x in D.lag_correlation(spark.createDataFrame(rows, "g string, date date, a double, b double"), ["g"], "a", "b", 5).collect()}
    assert got["x", 3].correlation > 0.99 and max((v.correlation, k) for k, v in got.items() if k[0] == "x")[1] == ("x", 3)
    assert got["x", 3].n == 57 and all(v.correlation is None for k, v in got.items() if k[0] == "flat")


def test_diverse_choice_without_noise_and_quota(spark):
    rows = [(1, 730, ["Action"], ["a"]), (2, 20, ["Indie", "Early Access"], ["b"]), (3, 30, ["Indie", "Action"], ["Singleplayer", "Surreal", "c"]), (4, 40, ["Puzzle"], ["Singleplayer", "Surreal", "d"]), (5, 50, ["Racing"], ["e"])]
    candidates = spark.createDataFrame(rows, "ordinal long, game_id long, genres array<string>, tags array<string>")
    labels = spark.createDataFrame([(g, y) for g in (730, 20, 30, 40) for y in (0, 1)] + [(50, 1)], "game_id long, label int")
    got = sampling.select_diverse(candidates, complete=sampling.complete_groups(labels, "game_id", "label", 1)).collect()
    assert [(r.game_id, r.genres, r.tags) for r in got] == [(30, ["Action"], ["c"]), (40, ["Puzzle"], ["d"])]
    assert [r.game_id for r in sampling.select_diverse(candidates, noise_genres=[], noise_tags=[], excluded=[]).collect()] == [730, 20, 30, 50]


def test_language_stage_is_asked_last(spark):
    text = {"en": "the game is good and the story holds up to the end", "fr": "le jeu est bon et la fin de cette histoire aussi"}
    train = spark.createDataFrame([(k, t) for k, t in text.items()] * 3, "language string, review_text string")
    score = quality.english_score(quality.language_profiles(train))
    rows = spark.createDataFrame([(1, text["en"]), (2, text["fr"]), (3, None), (4, "short"), (5, "été " * 20), (6, "12345 67890 12345 67890")], "review_id long, review_text string")
    assert {r.review_id for r in quality.valid_reviews(rows, language_score=score).collect()} == {1}
    got = {r.stage: r.n for r in quality.funnel(rows, language_score=score).collect()}
    assert got == {"valid": 1, "not_english": 1, "empty": 1, "too_short": 1, "non_ascii": 1, "few_letters": 1}
    none = quality.english_score(spark.createDataFrame([], "language string, gram string, logp double"))
    assert quality.valid_reviews(rows, language_score=none).collect() == []
    p = {r.language: r.p for r in quality.language_scores(rows.where("review_id = 2"), quality.language_profiles(train)).collect()}
    assert set(p) == {"en", "fr"} and p["fr"] > 0.99 and abs(sum(p.values()) - 1) < 1e-9
