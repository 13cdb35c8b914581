"""Registration of queries, and the SQL views that stand for their inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "reviews": """SELECT doc_id AS review_id, text AS review_text, lang AS language, source AS game_name,
        CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS game_id, doc_id % 50 AS votes_up,
        1704067200 + (doc_id * 9973) % 2592000 AS timestamp_created, CAST(doc_id % 97 AS VARCHAR) AS author, n_chars FROM documents""",
    "labelled": """SELECT r.*, CAST(l.quality AS INTEGER) AS label, CAST(1 - l.toxic AS INTEGER) AS pred_a,
        CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS pred_b, 0.5 + CAST(review_id * 7919 % 500 AS DOUBLE) / 1000 AS confidence
        FROM reviews r JOIN labels l ON l.doc_id = r.review_id""",
    "errs_a": "SELECT *, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM labelled WHERE label <> pred_a",
    "errs_b": "SELECT *, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM labelled WHERE label <> pred_b",
    "changed": """SELECT *, 'fixed' AS bucket FROM errs_a a WHERE NOT EXISTS (SELECT 1 FROM errs_b b WHERE b.review_text IS NOT DISTINCT FROM a.review_text)
        UNION ALL SELECT *, 'broke' FROM errs_b b WHERE NOT EXISTS (SELECT 1 FROM errs_a a WHERE a.review_text IS NOT DISTINCT FROM b.review_text)""",
    "tok": """SELECT review_id, CAST(pos - 1 AS INTEGER) AS pos, t[pos] AS token FROM (SELECT review_id, t, unnest(range(1, len(t) + 1)) AS pos
        FROM (SELECT review_id, regexp_extract_all(lower(review_text), '[a-z'']+') AS t FROM {errors}))""",
    "scored": "SELECT *, (CAST((length(token) * 31 + pos * 17 + review_id) % 200 AS DOUBLE) - 100) / 100 AS score FROM tok",
    "runs": """SELECT game_id AS seed, 'a' AS base, round(100.0 * sum(CASE WHEN label = pred_a THEN 1 ELSE 0 END) / count(*), 6) AS ood_acc FROM labelled GROUP BY 1
        UNION ALL SELECT game_id, 'b', round(100.0 * sum(CASE WHEN label = pred_b THEN 1 ELSE 0 END) / count(*), 6) FROM labelled GROUP BY 1""",
    "curve": """SELECT CASE WHEN n_chars < 500 THEN 500 WHEN n_chars < 2000 THEN 2000 ELSE 20000 END AS data_size, review_id % 3 AS trial,
        round(100.0 * sum(CASE WHEN label = pred_a THEN 1 ELSE 0 END) / count(*), 6) AS test_acc,
        round(100.0 * sum(CASE WHEN label = pred_b THEN 1 ELSE 0 END) / count(*), 6) AS val_acc FROM labelled GROUP BY 1, 2""",
    "topical": "SELECT r.*, CAST(coalesce(g.topic, -1) AS INTEGER) AS topic_id FROM reviews r LEFT JOIN (SELECT vec_id, min(label) AS topic FROM embeddings GROUP BY 1) g ON g.vec_id = r.review_id",
}


def sql(body: str, *views: str, **fill: str) -> str:
    """``body`` over the named views, in the order given."""
    parts = [f"{v} AS ({VIEWS[v].replace('{errors}', fill.get('errors', 'errs_a'))})" for v in views]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(text: str | None = None):
    """Registers a query under its function's name; ``text`` is its SQL, if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add
