"""The pipeline's stages against plain Python, each on its own input, over edge cases and over the table."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as C
import pytest

from gleanery.llm import mixing
from llm.test_texts import SCHEMA, encoded_by_hand, grams, repeats_by_hand, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def test_language_stage(spark, docs):
    got = C.language(spark, docs, "")
    assert got.columns == list(C.COLUMNS)
    assert got.count() == sum(bool(t and re.search(r"[^\W\d_]", t)) for _, t, *_ in rows())
    assert got.where("lang is null").count() == 0


def firsts_by_hand(texts):
    """(doc_id, text) of one document of each group of ``texts`` (doc_id, text): the smallest doc_id, then the smallest digest."""
    sets, group = [grams(t) for _, t in texts], list(range(len(texts)))
    while True:  # to the smallest member that links reach
        before = list(group)
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    best = {}
    for k, (i, t) in enumerate(texts):
        name = group[k] if sets[k] else (i, t)
        best[name] = min(best.get(name, (1 << 60,)), (i, hashlib.md5((t or "").encode()).hexdigest(), t), key=lambda x: x[:2])
    return sorted(((i, t) for i, _, t in best.values()), key=str)


def test_near_duplicate_stage(spark, docs):
    """One document of each group, by hand: rows that only share a doc_id both stay, of repeated rows one."""
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").where("doc_id is not null").collect()), key=str)
    assert got == firsts_by_hand([r[:2] for r in rows() if r[0] is not None])
    assert sum(i == 5 for i, _ in got) == 2 and sum(i == 2 for i, _ in got) == 1


def test_passage_stage(spark, docs):
    got = {(r.doc_id, r.text): r for r in C.repeated_passages(spark, docs, "").collect()}
    for i, n, gone, digest in repeats_by_hand([r[:2] for r in rows()]):
        mine = [r for (k, t), r in got.items() if k == i and hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == digest]
        assert bool(mine) == (n == 0 or gone < n)
        assert all(r.n_chars == len(r.text) for r in mine if gone)


def test_mixing_stage(spark, docs):
    """What the draw keeps, as whole rows: the same rows however they are dealt, none twice, none changed."""
    got = Counter(map(tuple, C.mixed(spark, docs, "").collect()))
    given = Counter(map(tuple, docs.select(*C.COLUMNS).collect()))
    assert got and not got - given and given - got
    assert got == Counter(map(tuple, C.mixed(spark, docs.repartition(7), "").collect()))
    kept = {(r.doc_id, r.text): r.kept for r in mixing.mix(docs, carry=("text",)).collect()}
    assert all(((i, t) in {x[:2] for x in got}) == k for (i, t), k in kept.items())
    same = docs.where("doc_id = 1").select(*C.COLUMNS)  # equal doc_ids are drawn alike
    assert C.mixed(spark, same.unionByName(same).unionByName(same), "").count() in (0, 3)


def test_encoding_stage(spark, docs):
    got = C.encoded(spark, docs, "").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(encoded_by_hand(r[:2] for r in rows()))
    assert all(len(r.token_ids) == r.n_tokens for r in got)


def test_stages_in_turn_equal_by_hand(spark, sf_dir):
    """Each stage over what its predecessor kept of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = C.language(spark, docs, sf_dir).cache()
    first = [tuple(r) for r in named.select("doc_id", "text").collect()]
    assert sorted(first) == sorted((r.doc_id, r.text) for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    once = C.near_duplicates(spark, named, sf_dir).cache()
    second = sorted(((r.doc_id, r.text) for r in once.collect()), key=str)
    assert second == firsts_by_hand(first) and len(second) < len(first)
    cut = C.repeated_passages(spark, once, sf_dir).cache()
    third = {r.doc_id: r.text for r in cut.collect()}
    digests = {i: digest for i, n, gone, digest in repeats_by_hand(second) if n == 0 or gone < n}
    assert {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in third.items()} == digests
    drawn = C.mixed(spark, cut, sf_dir).cache()
    fourth = [(r.doc_id, r.text) for r in drawn.collect()]
    assert fourth and all(third[i] == t for i, t in fourth)
    last = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.encoded(spark, drawn, sf_dir).collect()}
    assert last == set(encoded_by_hand(fourth))
    assert last == {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, sf_dir).collect()}


def test_run(spark, sf_dir):
    first = {r.doc_id: r for r in C.run(spark, sf_dir).collect()}
    second = {r.doc_id: r for r in C.run(spark, sf_dir).collect()}
    assert first == second and first
    assert all(len(r.token_ids) == r.n_tokens for r in first.values())
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert any(hashlib.sha256(given[i].encode()).hexdigest() == r.decoded_sha256 for i, r in first.items())


def test_stages_on_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0
