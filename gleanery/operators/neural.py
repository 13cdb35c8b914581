"""A text classifier with one hidden layer, trained by epochs with early stopping, and its integrated gradients.

A text is its unit vector of hashed tokens. An epoch is one pass in which every shard of the training rows is learned by a task from the
shared weights on, in mini-batches; the shards' changes are averaged, weighted by their rows, and the rows held back for validation
decide whether the epoch counts. The weights, slots times hidden units, are broadcast; their size doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.reduction import SLOTS, slot_counts, times, weighted_rows
from gleanery.sources.scratch import materialize

_EVEN = np.ones(SLOTS)
#: Rows explained at a time: their tokens and scores are held together.
STEP = 256
HISTORY = "run long, epoch long, train_loss double, val_accuracy double, test_accuracy double"


@dataclass
class Network:
    """One matrix: a row of weights for each slot, then the hidden bias, the output weights and, first in the last row, the output bias."""

    weights: np.ndarray

    @staticmethod
    def start(hidden: int, seed: int) -> Network:
        weights = np.random.default_rng(seed).normal(size=(SLOTS + 3, hidden)) * 0.1
        weights[SLOTS], weights[SLOTS + 2] = 0.0, 0.0
        return Network(weights)

    def outputs(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of label 1, hidden values) of rows of summed input weights."""
        z = np.tanh(sums + self.weights[SLOTS])
        return 1.0 / (1.0 + np.exp(-np.clip(z @ self.weights[SLOTS + 1] + self.weights[SLOTS + 2, 0], -40.0, 40.0))), z


@dataclass
class Shard:
    """Rows end to end: ``slots`` and ``weights`` of all, where each row ends, and its label."""

    slots: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Shard:
        """From (shard, slots, weights, label) of each row."""
        return Shard(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), np.cumsum([len(r[1]) for r in rows]), np.array([r[3] for r in rows]))

    def part(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row from 0, slot, weight, label) of the rows from ``at`` to ``stop``."""
        low, ends = (self.ends[at - 1] if at else 0), self.ends[at:stop]
        sizes = np.diff(ends, prepend=low)
        return np.repeat(np.arange(len(sizes)), sizes), self.slots[low : ends[-1]], self.weights[low : ends[-1]], self.labels[at:stop]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The rows of each shard, which come in a run; one shard is held at a time, as flat arrays."""
    now, held = None, []

    def whole() -> Shard:
        slots, weights, sizes, labels = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return Shard(slots, weights, np.cumsum(sizes), labels)

    for batch in batches:
        shard, label = batch.column("shard").to_numpy(), batch.column("label").to_numpy()
        for row, slot, weight in weighted_rows(batch, _EVEN):
            cuts = np.flatnonzero(np.diff(shard[row])) + 1
            for own, s, w in zip(np.split(row, cuts), np.split(slot, cuts), np.split(weight, cuts)):
                if not len(own):
                    continue
                if held and shard[own[0]] != now:
                    yield whole()
                now = shard[own[0]]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                held.append((s.copy(), w, np.diff(first, append=len(own)), label[own[first]].astype(np.int8)))
    if held:
        yield whole()


def _learn(net: Network, rows: Shard | list[tuple], rate: float, batch: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights after the shard, touched rows, summed loss): mini-batches in the order given, a falling rate for each weight."""
    rows = rows if isinstance(rows, Shard) else Shard.of(rows)
    w, seen, touched, loss = net.weights.copy(), np.full(net.weights.shape, 1e-3), np.zeros(len(net.weights), bool), 0.0
    own, sum_of = Network(w), np.zeros((SLOTS, w.shape[1]))
    for at in range(0, len(rows.labels), batch):
        row, slot, weight, y = rows.part(at, at + batch)
        _, sums = times(row, slot, weight, w[:SLOTS])
        p, z = own.outputs(sums)
        loss -= float(np.log(np.clip(np.where(y == 1, p, 1.0 - p), 1e-12, 1.0)).sum())
        error = (p - y) / len(y)
        inner = error[:, None] * w[SLOTS + 1] * (1.0 - z * z)
        inputs = np.flatnonzero(np.bincount(slot, minlength=SLOTS))
        # a row's slots differ, so its gradient can be added in place
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for i, low, high in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
            sum_of[slot[low:high]] += weight[low:high, None] * inner[i]
        grad = np.zeros((len(inputs) + 3, w.shape[1]))
        grad[:-3], sum_of[inputs] = sum_of[inputs], 0.0
        grad[-3], grad[-2], grad[-1, 0] = inner.sum(axis=0), error @ z, error.sum()
        places = np.concatenate([inputs, [SLOTS, SLOTS + 1, SLOTS + 2]])
        seen[places] += grad * grad
        w[places] -= rate * grad / np.sqrt(seen[places])
        touched[places] = True
    return w, np.flatnonzero(touched), loss


def _epoch(train: DataFrame, net: Network, rate: float, batch: int) -> tuple[Network, float]:
    shipped, width = train.sparkSession.sparkContext.broadcast(net), net.weights.shape[1]
    schema = "slot int, n double, change array<double>"

    def emit(slots: np.ndarray, n: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(slots), 4096):
            part = slice(at, at + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(slots[part].astype(np.int32)), pa.array(n[part]), pa.array(list(change[part]), pa.list_(pa.float64()))], names=["slot", "n", "change"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            n = len(rows.labels)
            after, touched, loss = _learn(shipped.value, rows, rate, batch)
            yield from emit(touched, np.full(len(touched), float(n)), (after - shipped.value.weights)[touched] * n)
            yield from emit(np.array([-1]), np.array([float(n)]), np.array([[loss, *[0.0] * (width - 1)]]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(SLOTS + 4), np.zeros((SLOTS + 4, width))
        for b in batches:
            at = b.column("slot").to_numpy() + 1
            np.add.at(n, at, b.column("n").to_numpy())
            np.add.at(total, at, b.column("change").flatten().to_numpy().reshape(-1, width))
        own = np.flatnonzero(n)
        yield from emit(own - 1, n[own], total[own])

    got = train.mapInArrow(learn, schema).repartition("slot").mapInArrow(added, schema).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    change = got["change"].combine_chunks().flatten().to_numpy().reshape(-1, width) / n[:, None]
    weights = net.weights.copy()
    weights[slot[slot >= 0]] += change[slot >= 0]
    return Network(weights), float(change[slot < 0][0, 0])


def prepare(labelled: DataFrame, text: str = "review_text", key: str = "review_id") -> DataFrame:
    """(key, slots, counts, label, split) of rows with a label of 0 or 1 and a split; rows without a token are left out."""
    rows = labelled.where("label in (0, 1)")
    counted = slot_counts(rows, T.tokens(F.col(text)), key).where("size(slots) > 0")
    return materialize(counted.join(rows.select(F.col(key).alias("key"), F.col("label").cast("int").alias("label"), "split").dropDuplicates(["key"]), "key"))


def train(rows: DataFrame, hidden: int = 16, epochs: int = 10, patience: int = 3, rate: float = 0.2, batch: int = 32, shard_rows: int = 20_000, seed: int = 42) -> tuple[Network, list[tuple]]:
    """(the weights of the best epoch, history) from ``prepare``'s rows: splits train, validation and test.

    An epoch is the best if its validation accuracy beats every one before; after ``patience`` epochs in a row that don't, training stops. Shards of about
    ``shard_rows`` rows and the order within them follow the hash of the key, so results don't depend on partitions but for the last digits of sums. Without training or
    validation rows it raises. History: (epoch, train_loss, val_accuracy, test_accuracy); the last is null without test rows."""
    n = {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if not n.get("train") or not n.get("validation"):
        raise ValueError("training needs rows of the splits train and validation")
    shards = -(-n["train"] // shard_rows)
    order = F.xxhash64(F.lit(seed), "key")
    own = rows.where("split = 'train'").withColumn("shard", F.pmod(order, F.lit(shards)).cast("int"))
    dealt = own.repartition(shards, "shard").sortWithinPartitions("shard", order, "key").select("shard", "slots", "counts", "label").persist(StorageLevel.DISK_ONLY)  # every epoch reads the shards again
    held = rows.where("split <> 'train'")
    net, best, since, history, kept = Network.start(hidden, seed), -1.0, 0, [], None
    for epoch in range(1, epochs + 1):
        net, loss = _epoch(dealt, net, rate, batch)
        right = {r.split: r.share for r in predict(held, net).join(held.select("key", "label", "split"), "key").groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("share")).collect()}
        history.append((epoch, loss, right["validation"], right.get("test")))
        if right["validation"] > best:
            best, since, kept = right["validation"], 0, net
        else:
            since += 1
            if since >= patience:
                break
    dealt.unpersist()
    return kept, history


def predict(counted: DataFrame, net: Network) -> DataFrame:
    """(key, probability, prediction) of rows with slots and counts; a row without tokens has the bias alone. No shuffle."""
    shipped = counted.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, own.weights.shape[1]))
            for row, slot, weight in weighted_rows(batch, _EVEN):
                at, part = times(row, slot, weight, own.weights[:SLOTS])
                sums[at] = part
            p, _ = own.outputs(sums)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["key", "probability", "prediction"])

    return counted.select("key", "slots", "counts").mapInArrow(run, f"key {dict(counted.dtypes)['key']}, probability double, prediction int")


def integrated_gradients(docs: DataFrame, net: Network, steps: int = 32, text: str = "review_text", key: str = "review_id") -> DataFrame:
    """(key, prediction, output, baseline, tokens, scores) for every row of ``docs``: what each token of the whole text adds to the probability of the predicted class.

    Gradients are integrated along the line from the empty text to the text (Gauss-Legendre, ``steps`` points), so the scores of a row add up to
    output less baseline. Equal tokens of a row share equally. A null text has no tokens. Rows map one to one; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    places, shares = np.polynomial.legendre.leggauss(steps)
    places, shares = (places + 1.0) / 2.0, shares / 2.0

    def explain(own: Network, slots: np.ndarray) -> tuple[int, float, float, np.ndarray]:
        found, at, counts = np.unique(slots, return_inverse=True, return_counts=True)
        value = 1.0 + np.log(counts)
        value /= np.sqrt((value * value).sum()) if len(value) else 1.0
        sums = value @ own.weights[found] if len(found) else np.zeros(own.weights.shape[1])
        p, z = own.outputs(np.concatenate([places[:, None] * sums, [sums, 0 * sums]]))
        slope = (p * (1.0 - p))[:-2, None] * own.weights[SLOTS + 1] * (1.0 - z[:-2] ** 2)
        score = value * (own.weights[found] @ (shares @ slope)) / counts
        label = int(p[-2] >= 0.5)
        return label, *((float(p[-2]), float(p[-1]), score[at]) if label else (1.0 - float(p[-2]), 1.0 - float(p[-1]), -score[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            out = [explain(shipped.value, s.values.to_numpy() if s.is_valid else np.empty(0, np.int32)) for s in batch.column("slots")]
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns[:3], batch.column("tokens"), columns[3]], names=["key", "prediction", "output", "baseline", "tokens", "scores"])

    tokens = T.tokens(F.col(text))
    rows = docs.select(F.col(key).alias("key"), tokens.alias("tokens")).withColumn("slots", F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")))
    schema = f"key {dict(docs.dtypes)[key]}, prediction int, output double, baseline double, tokens array<string>, scores array<double>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def token_rows(explained: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, pos, token, score): a row a token, by place from 0."""
    return explained.select(key, F.posexplode(F.arrays_zip("tokens", "scores")).alias("pos", "t")).select(key, "pos", F.col("t.tokens").alias("token"), F.col("t.scores").alias("score"))


def history_frame(spark, history: list[tuple], run: int = 1) -> DataFrame:
    return spark.createDataFrame([(run, *h) for h in history], HISTORY)
