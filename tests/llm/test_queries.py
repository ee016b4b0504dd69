"""Every registered query with its production parameters, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest

from skarn.llm.queries import ORACLE_SQL, QUERIES

from ..compare import DATA, duck_rows, oracle, spark_rows

#: Columns that a query returns first, and the table of which it returns a row a row (None: another number).
SHAPES = {
    "op1_brown_classes": (["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "documents"),
    "op2_robust_outliers": (["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "documents"),
    "op3_site_templates": (["page_id", "url", "text", "n_chars"], "pages"),
    "op4_merge_dropout": (["doc_id"], "documents"),
    "op5_vector_packing": (["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None),
    "op6_bottom_k_near_dups": (["doc_id", "n_shingles", "component_id", "kept"], "documents"),
    "op7_block_bounds": (["query_id", "rank", "vec_id", "score"], None),
    "op8_reversible_lines": (["doc_id", "n_lines", "n_dropped", "kept_sha256"], "documents"),
    "op9_arc_to_warc": (["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "pages"),
    "op10_plane_files": (["doc_id", "start", "n_tokens", "ids_crc32"], "documents"),
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        assert spark_rows(df) == duck_rows(oracle(), ORACLE_SQL[name])
    columns, table = SHAPES[name]
    assert df.columns[: len(columns)] == columns
    if table:
        key = columns[0]
        assert Counter(r[0] for r in df.select(key).collect()) == Counter(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
