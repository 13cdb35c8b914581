"""Masked-token probabilities against plain counts."""

import math
import random
from collections import Counter

import pytest

from gleanery.operators import adaptation as A


def by_hand(general, asked):
    c = [Counter() for _ in range(7)]
    keys = lambda x, w, y: ((x, w, y), (x, y), (x, w), (w, y), (x,), (y,), (w,))
    for place in general:
        for k, key in zip(c, keys(*place)):
            k[key] += 1
    n, v = len(general), len({w for _, w, _ in general})
    out = {}
    for place in asked:
        ltr, lr, lt, tr, x, y, t = (k[key] for k, key in zip(c, keys(*place)))
        alone = (t + 1) / (n + v + 1)
        out[place] = (ltr + 2 * (lt + tr + 2 * alone) / (x + y + 2)) / (lr + 2)
    return out


def places(texts):
    return [(t[i - 1] if i else "", w, t[i + 1] if i + 1 < len(t) else "") for t in (x.split() for x in texts) for i, w in enumerate(t)]


def test_probabilities_equal_by_hand_and_sum_to_one(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "review_id long, review_text string")
    found = A.contexts(df)
    assert sorted((x.left, x.token, x.right) for x in found.collect()) == sorted(places(texts))
    asked = [(x, w, y) for x in ("a", "", "q") for y in ("b", "") for w in "abcdez"]
    got = {(x.left, x.token, x.right): x.p for x in A.probabilities(spark.createDataFrame(asked, "left string, token string, right string"), A.context_counts(found)).collect()}
    want = by_hand(places(texts), asked)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # "z" stands for any token that was never seen
    assert all(abs(sum(want[x, w, y] for w in "abcdez") - 1) < 1e-12 for x in ("a", "", "q") for y in ("b", ""))


def test_adaptation_lowers_perplexity(spark):
    r = random.Random(1)
    make = lambda words, n: spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(20))) for i in range(n)], "review_id long, review_text string")
    general, domain, held = make(["the", "a", "of"], 50), make(["loot", "boss", "the"], 50), A.contexts(make(["loot", "boss", "the"], 10))
    base, own = A.context_counts(A.contexts(general)), A.context_counts(A.contexts(domain))
    before, after = A.perplexity(held, base).first(), A.perplexity(held, A.adapted(base, own)).first()
    assert before.n == after.n == 200 and after.perplexity < before.perplexity / 2 and after.perplexity < 6
    none = A.perplexity(held.where("false"), base).first()
    assert (none.n, none.perplexity) == (0, None)
    rows = places(["x y"] * 3)
    p = by_hand(rows, [("", "x", "y")])["", "x", "y"]
    one = spark.createDataFrame([(1, "x y")] * 3, "review_id long, review_text string")
    got = A.perplexity(A.contexts(one).where("token = 'x'"), A.context_counts(A.contexts(one))).first()
    assert got.n == 3 and got.perplexity == pytest.approx(math.exp(-math.log(p)))
