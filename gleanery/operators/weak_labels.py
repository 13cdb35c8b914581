"""Kinds of topics by rules first, then by hand, then by a classifier.

Rules fire on some reviews and say one kind each. How far a rule is to be believed is estimated from how rules fire together and from reviews
labelled by hand, by a latent-class model over the few patterns in which rules fire. Reviews that rules or hands settle train a classifier for the rest; a topic is
what most of its reviews are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import lexicon as L
from gleanery.functions import text as T
from gleanery.sources.scratch import materialize

KINDS = ("element", "quality", "business")
#: Rule: its words and the kind it stands for.
RULES = {"defects": (L.BUG_CRASH, "quality"), "makers": (L.DEV_CRITICISM, "quality"), "payment": (L.DLC_MONETIZATION, "business")}


@dataclass
class Beliefs:
    """``share`` of each kind; ``fires``: how often each rule fires on reviews of each kind; ``accuracy``: share of a rule's reviews that are of its kind, null if it never fires."""

    rules: list[str]
    share: np.ndarray
    fires: np.ndarray
    accuracy: dict[str, float | None]

    def posterior(self, pattern: str) -> np.ndarray:
        """Chances of each kind for a pattern of 0 and 1, one place a rule."""
        fired = np.array([c == "1" for c in pattern])
        p = self.share * np.where(fired[:, None], self.fires, 1.0 - self.fires).prod(axis=0)
        return p / p.sum()


def fired(df: DataFrame, rules: dict = RULES, text: str = "review_text") -> DataFrame:
    """``df`` with ``pattern``: for each rule 1 if it fires, else 0; null texts fire none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("pattern", F.concat(*[T.contains_any(low, words).cast("int").cast("string") for words, _ in rules.values()]))


def beliefs(patterns: list[tuple[str, str | None, int]], rules: dict = RULES, rounds: int = 50) -> Beliefs:
    """From (pattern, kind by hand or None, reviews): expectation and maximisation, starting from rules that are mostly right; one imagined review for and against everything."""
    kinds = [kind for _, kind in rules.values()]
    fire = np.array([[c == "1" for c in p] for p, _, _ in patterns], float).reshape(len(patterns), len(rules))
    n = np.array([k for *_, k in patterns], float)
    known = np.array([[float(h == k) for k in KINDS] if h else [0.0] * len(KINDS) for _, h, _ in patterns]).reshape(-1, len(KINDS))
    out = Beliefs(list(rules), np.full(len(KINDS), 1 / len(KINDS)), np.array([[0.5 if k == kind else 0.02 for k in KINDS] for kind in kinds]), {})
    post = known
    for _ in range(rounds):
        post = np.array([known[i] if h else out.posterior(p) for i, (p, h, _) in enumerate(patterns)]).reshape(-1, len(KINDS))
        weight = n[:, None] * post
        out.share = (weight.sum(axis=0) + 1) / (n.sum() + len(KINDS))
        out.fires = (fire.T @ weight + 1) / (weight.sum(axis=0) + 2)
    for r, (name, kind) in enumerate(zip(rules, kinds)):
        total = float(n @ fire[:, r])
        out.accuracy[name] = float((n * fire[:, r]) @ post[:, KINDS.index(kind)]) / total if total else None
    return out


def review_kinds(df: DataFrame, by_hand: DataFrame, rules: dict = RULES, sure: float = 0.8, slots: int = 1 << 14, key: str = "review_id", text: str = "review_text") -> tuple[DataFrame, Beliefs]:
    """((key, kind, stage) of every row of ``df``, the beliefs). Stage: ``hand`` for keys in ``by_hand`` (key, kind), ``rules`` where a rule fires and the chance of one kind is
    ``sure``, else ``classifier``.

    Keys are unique in ``df``; of several labels by hand the first by name counts. Where hands and rules settle fewer than two kinds there is nothing to tell apart: the rest is
    the likeliest kind for its pattern. Patterns are at most two to the number of rules; the fit reads the settled rows where they lie."""
    hand = by_hand.where(F.col("kind").isin(*KINDS)).groupBy(key).agg(F.min("kind").alias("hand"))
    voted = materialize(fired(df, rules, text).select(key, text, "pattern").join(hand, key, "left"))
    found = beliefs([(r.pattern, r.hand, r.n) for r in voted.groupBy("pattern", "hand").agg(F.count("*").alias("n")).orderBy("pattern", "hand").collect()], rules)
    seen = [r.pattern for r in voted.select("pattern").distinct().collect()]
    rows = [(p, KINDS[int(q.argmax())], float(q.max())) for p in seen for q in [found.posterior(p)]]
    facts = df.sparkSession.createDataFrame(rows, "pattern string, likely string, chance double")
    staged = voted.join(F.broadcast(facts), "pattern")
    by_rule = F.col("pattern").contains("1") & (F.col("chance") >= sure)
    staged = staged.withColumn("stage", F.when(F.col("hand").isNotNull(), "hand").when(by_rule, "rules").otherwise("classifier")).withColumn("kind", F.coalesce("hand", "likely"))
    settled, rest = staged.where("stage <> 'classifier'"), staged.where("stage = 'classifier'")
    if settled.select("kind").distinct().count() > 1 and not rest.isEmpty():
        number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("double") - 1
        filled = lambda d: d.withColumn("__t", F.coalesce(text, F.lit("")))
        weight = F.when(F.col("stage") == "hand", 1.0).otherwise(F.col("chance"))
        words = RegexTokenizer(inputCol="__t", outputCol="__w", pattern="[^a-z']+")
        counts = HashingTF(inputCol="__w", outputCol="features", numFeatures=slots, binary=True)
        model = Pipeline(stages=[words, counts, LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight", family="multinomial")]).fit(filled(settled).select("__t", number.alias("label"), weight.alias("weight")))
        told = model.transform(filled(rest))
        rest = told.withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), F.col("prediction").cast("int")))
    return settled.select(key, "kind", "stage").unionByName(rest.select(key, "kind", "stage")), found


def majority(topics: DataFrame, kinds: DataFrame, key: str = "review_id") -> DataFrame:
    """(topic_id, kind, votes): what most reviews of each topic are, ties by name."""
    votes = topics.select(key, "topic_id").join(kinds.select(key, "kind"), key).groupBy("topic_id", "kind").agg(F.count("*").alias("votes"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("votes"), "kind"))).where("r = 1").drop("r")
