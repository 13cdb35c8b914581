"""Rules, hands and the classifier."""

import itertools
import random

import pytest

from gleanery.operators import weak_labels as W


def test_beliefs_recover_how_rules_fire():
    """Patterns drawn from known chances: shares, firing and accuracies come back."""
    r = random.Random(0)
    share, fires = (0.6, 0.3, 0.1), {"defects": (0.02, 0.7, 0.02), "makers": (0.1, 0.4, 0.05), "payment": (0.03, 0.02, 0.8)}
    counts, right, total = {}, dict.fromkeys(fires, 0), dict.fromkeys(fires, 0)
    for i in range(20_000):
        kind = r.choices(range(3), share)[0]
        on = {k: r.random() < f[kind] for k, f in fires.items()}
        key = "".join("01"[on[k]] for k in fires), W.KINDS[kind] if i % 10 == 0 else None
        counts[key] = counts.get(key, 0) + 1
        for k in fires:
            total[k] += on[k]
            right[k] += on[k] and W.KINDS[kind] == W.RULES[k][1]
    found = W.beliefs([(p, h, n) for (p, h), n in sorted(counts.items(), key=str)])
    assert found.share == pytest.approx(share, abs=0.05)
    assert all(found.accuracy[k] == pytest.approx(right[k] / total[k], abs=0.07) for k in fires)
    for bits in itertools.product("01", repeat=3):
        p = found.posterior("".join(bits))
        assert p.sum() == pytest.approx(1) and (p >= 0).all()
    assert found.posterior("100").argmax() == 1 and found.posterior("001").argmax() == 2 and found.posterior("000").argmax() == 0


def test_the_classifier_settles_what_no_rule_does(spark):
    r = random.Random(1)
    said = {"element": ["story", "combat", "music"], "quality": ["server", "patch", "desync"], "business": ["price", "sale", "refund"]}
    rule_word = {"quality": "crashes", "business": "dlc"}
    rows, truth = [], {}
    for i in range(360):
        kind = W.KINDS[i % 3]
        words = [r.choice(said[kind]) for _ in range(4)] + [r.choice(["the", "game", "has"]) for _ in range(5)]
        if kind in rule_word and r.random() < 0.6:
            words.append(rule_word[kind])
        r.shuffle(words)
        rows.append((i, " ".join(words), i % 3 + 3 * (i % 2)))
        truth[i] = kind
    rows += [(1000, None, 9), (1001, "", 9), (1002, "crashes and dlc", 9)]
    df = spark.createDataFrame(rows, "review_id long, review_text string, topic_id int")
    hand = spark.createDataFrame([(i, truth[i]) for i in range(0, 90)] + [(5000, "element"), (1, "nonsense"), (0, "quality")], "review_id long, kind string")
    kinds, found = W.review_kinds(df, hand)
    got = {x.review_id: (x.kind, x.stage) for x in kinds.collect()}
    assert set(got) == {x[0] for x in rows} and got[0] == ("element", "hand") and all(got[i] == (truth[i], "hand") for i in range(1, 90))
    rest = [i for i in range(90, 360) if got[i][1] == "classifier"]
    assert len(rest) > 80 and sum(got[i][0] == truth[i] for i in rest) / len(rest) > 0.95
    assert all(got[i] == (truth[i], "rules") for i in range(90, 360) if got[i][1] == "rules")
    assert all(found.accuracy[k] > 0.9 for k in ("defects", "payment")) and found.accuracy["makers"] is None
    topics = {x.topic_id: (x.kind, x.votes) for x in W.majority(df, kinds).collect()}
    assert all(topics[t][0] == W.KINDS[t % 3] for t in range(6)) and len(topics) == 7
    only, _ = W.review_kinds(df, hand.where("false"), sure=2.0)
    assert {x.stage for x in only.collect()} == {"classifier"}
    assert W.review_kinds(df.where("false"), hand)[0].collect() == []
