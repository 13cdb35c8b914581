"""The registered queries: names, columns, and rows against DuckDB where SQL expresses them."""

import re

import oracle
import pytest

from gleanery.llm import queries

COLUMNS = {
    1: "doc_id held_out lang_pred score", 2: "doc_id n_bytes n_tokens over_limit", 3: "doc_id class_id n_links", 4: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    5: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 6: "vec_id n_links component_id kept", 7: "doc_id n_words n_removed kept_sha256",
    8: "doc_id n_tokens ids_sha256 decoded_sha256", 9: "doc_id probability kept", 10: "page_id host path rule verdict",
    11: "doc_id held_out score predicted", 12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", 13: "vec_id component n deviation whitened explained identity_error",
}


def test_one_query_for_each_operator(spark, sf_dir):
    found = {int(re.match(r"op(\d+)_", n)[1]): f for n, f in queries.QUERIES.items()}
    assert sorted(found) == list(range(1, 14))
    for n, f in found.items():
        assert set(COLUMNS[n].split()) <= set(f(spark, sf_dir).columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.database(sf_dir), queries.SQL[name]) == ""
