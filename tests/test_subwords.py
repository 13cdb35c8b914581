"""Sub-word ids against a plain trie."""

import unicodedata

import public_tokenizers
import pytest

from gleanery.functions import text as T
from gleanery.operators import subwords
from pyspark.sql import functions as F

VOCABULARY = [*subwords.SPECIAL, "un", "##aff", "##able", "##a", "##ff", "play", "##ing", "the", "t", "##h", "##e", "!", ",", "cafe", "中"]


def by_hand(text, vocabulary, size):
    """One character at a time through two tries."""
    tries = ({}, {})
    for i, p in enumerate(vocabulary):
        node = tries[p.startswith("##")]
        for c in p.removeprefix("##"):
            node = node.setdefault(c, {})
        node[""] = i
    said, word = [], ""
    for c in unicodedata.normalize("NFD", (text or "").lower()):
        kind = unicodedata.category(c)
        alone = kind.startswith("P") or c in "$+<=>^`|~" or 0x4E00 <= ord(c) <= 0x9FFF
        if kind == "Mn":
            continue
        if alone or c.isspace() or kind == "Cc":
            said += [word] * bool(word) + [c] * alone
            word = ""
        else:
            word += c
    said += [word] * bool(word)
    out = []
    for w in said:
        at, found = 0, []
        while at < len(w) and len(w) <= 100:
            node, best = tries[at > 0], None
            for stop in range(at, len(w)):
                node = node.get(w[stop])
                if node is None:
                    break
                if "" in node:
                    best = (node[""], stop + 1)
            if best is None:
                found = None
                break
            found.append(best[0])
            at = best[1]
        out += found or [vocabulary.index("[UNK]")]
    row = [vocabulary.index("[CLS]"), *(out if size is None else out[: size - 2]), vocabulary.index("[SEP]")]
    gap = 0 if size is None else size - len(row)
    return row + [0] * gap, [1] * len(row) + [0] * gap, len(out)


TEXTS = [None, "", "unaffable", "Unaffable, playing THE game!", "Café the", "中中 the", "x" * 101, "thethe\tthe\x01the", "the " * 5000, "[CLS] [PAD]", "naïve—the ‘un’"]


@pytest.mark.parametrize("size", [8, 128, None])
def test_ids_equal_by_hand(spark, size):
    df = spark.createDataFrame([(i or None, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)], "review_id long, review_text string, input_ids int").repartition(3)
    got = sorted((r.review_id or 0, r.input_ids, r.attention_mask, r.n_pieces) for r in subwords.encode(df, VOCABULARY, size, memo=3).collect())
    assert got == sorted((i, *by_hand(t, VOCABULARY, size)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    assert subwords.encode(df.where("false"), VOCABULARY).collect() == []


def test_vocabulary_must_be_usable(spark):
    df = spark.createDataFrame([(1, "x")], "review_id long, review_text string")
    with pytest.raises(ValueError):
        subwords.encode(df, ["x"])
    with pytest.raises(ValueError):
        subwords.encode(df, VOCABULARY, 1)


def test_ids_of_every_text_and_meaningful_pieces(spark, sf_dir):
    vocabulary = subwords.vocabulary_from(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(vocabulary) == len(set(vocabulary)) > 20_000 and vocabulary[:4] == list(subwords.SPECIAL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as review_id", "text as review_text")
    found = subwords.encode(docs, vocabulary).cache()
    got = {r.review_id: (r.input_ids, r.attention_mask, r.n_pieces) for r in found.collect()}
    assert got == {r.review_id: by_hand(r.review_text, vocabulary, 128) for r in docs.collect()}
    pieces = subwords.pieces_of(found, vocabulary)
    kept = pieces.where(T.meaningful(F.col("token"))).select("token").distinct().collect()
    assert kept and not any(r.token.startswith(("##", "[")) for r in kept)
    assert pieces.where("token like '##%'").count() > 0 and pieces.where("token = '[CLS]'").count() == docs.count()
