"""Training by epochs, early stopping, and attributions that add up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import experiments, neural
from gleanery.operators.reduction import SLOTS


def reviews(n=600, noise=0.0, seed=0):
    r = np.random.default_rng(seed)
    good, bad, plain = (["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(k)] for k in (15, 15, 200))
    out = []
    for i in range(n):
        y = int(r.random() < 0.6)
        text = [plain[k] for k in r.integers(0, 200, int(r.integers(5, 40)))] + [(good if y else bad)[k] for k in r.integers(0, 15, 3)]
        out.append((i, " ".join(text[k] for k in r.permutation(len(text))), y if r.random() >= noise else 1 - y, "train" if i % 10 < 7 else "validation" if i % 10 < 8 else "test"))
    return out


SCHEMA = "review_id long, review_text string, label int, split string"


@pytest.mark.parametrize("shard_rows", [20_000, 150])
def test_epochs_learn_and_keep_the_best(spark, shard_rows):
    df = spark.createDataFrame(reviews(), SCHEMA).repartition(3)
    rows = neural.prepare(df)
    net, history = neural.train(rows, epochs=6, shard_rows=shard_rows)
    assert [h[0] for h in history] == list(range(1, len(history) + 1)) and history[-1][1] < history[0][1] < 0.75
    best = max(h[2] for h in history)
    assert best >= 0.9 and max(h[3] for h in history) >= 0.9
    val = rows.where("split = 'validation'")
    got = neural.predict(val, net).join(val.select("key", "label"), "key").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(got - best) < 1e-12
    again, same = neural.train(neural.prepare(df.repartition(5)), epochs=2, shard_rows=shard_rows)
    assert np.allclose([h[1:] for h in same], [h[1:] for h in history[:2]], atol=1e-6)


def test_training_stops_without_gain(spark):
    """Labels are a coin's: the history ends ``patience`` epochs after its best, as the early-stopping operator says."""
    df = spark.createDataFrame(reviews(300, noise=0.5, seed=4), SCHEMA)
    _, history = neural.train(neural.prepare(df), epochs=12, patience=2)
    stop = experiments.early_stopping(neural.history_frame(spark, history).withColumnRenamed("val_accuracy", "val_acc"), patience=2).first() if len(history) < 12 else None
    best = max(range(len(history)), key=lambda i: (history[i][2], -i)) + 1
    assert len(history) == 12 or (len(history) == best + 2 and (stop.stop_epoch, stop.best_epoch) == (len(history), best))
    with pytest.raises(ValueError):
        neural.train(neural.prepare(df.where("split = 'test'")))


def test_one_step_follows_the_gradient():
    """The change of a single mini-batch has the direction of a numeric gradient."""
    r = np.random.default_rng(0)
    net = neural.Network.start(4, 1)
    rows = [(0, np.sort(r.choice(50, 5, replace=False)), r.random(5), int(i % 2)) for i in range(8)]

    def loss(w):
        total = 0.0
        for _, slot, weight, y in rows:
            p, _ = neural.Network(w).outputs(weight @ w[slot][None].reshape(len(slot), -1))
            total -= np.log(p if y else 1 - p)
        return float(total) / len(rows)

    after, touched, _ = neural._learn(net, rows, 1e-3, 8)
    for at in [*touched[:6], SLOTS, SLOTS + 1]:
        for h in range(4):
            step = np.zeros_like(net.weights)
            step[at, h] = 1e-6
            slope = (loss(net.weights + step) - loss(net.weights - step)) / 2e-6
            moved = after[at, h] - net.weights[at, h]
            assert np.isclose(moved, -1e-3 * slope / np.sqrt(1e-3 + slope * slope), rtol=1e-3, atol=1e-9)


def test_attributions_add_up_and_find_what_decides(spark):
    df = spark.createDataFrame(reviews(), SCHEMA)
    net, _ = neural.train(neural.prepare(df), epochs=4)
    data = [(1, None), (2, ""), (None, df.first().review_text), (3, "word " * 30_000), (4000, "a b a")]
    every = df.select("review_id", "review_text").unionByName(spark.createDataFrame(data, "review_id long, review_text string"))
    explained = neural.integrated_gradients(every, net).collect()
    assert len(explained) == 605
    for r in explained:
        assert len(r.tokens or []) == len(r.scores) and abs(sum(r.scores) - (r.output - r.baseline)) < 1e-3 and r.output >= 0.5
    # the three words that carry the label outweigh the others in most texts
    words = {i: t for i, t, _, _ in reviews()}
    top = 0
    for r in explained:
        if r.review_id in words and r.tokens and len(r.tokens) > 8:
            order = sorted(zip(r.scores, r.tokens), reverse=True)
            counts = sum(order[0][1] in t.split() for t in words.values())
            top += counts < 200 and order[0][0] > 0
    assert top > 400
    rows = neural.token_rows(neural.integrated_gradients(every.where("review_id = 4000"), net)).collect()
    assert [(r.pos, r.token) for r in sorted(rows)] == [(0, "a"), (1, "b"), (2, "a")] and len({r.score for r in rows if r.token == "a"}) == 1
