"""Queries against their SQL on the smallest tables, and the columns that their contracts name."""

import compare
import pytest

from parcelforge.llm import oracle, queries

COLUMNS = {
    "op1": "doc_id n_shingles component_id", "op2": "doc_id n_words n_removed kept_sha256", "op3": "doc_id size source_size target taken", "op4": "page_id url text n_chars",
    "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6": "page_id payload_bytes payload_digest record_type refers_to",
    "op7": "doc_id held_out score predicted", "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10": "page_id host path rule verdict",
    "op11": "doc_id n_bytes n_removed n_spans kept_sha256", "op12": "word form root n n_near form_n", "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, con, name):
    df = queries.QUERIES[name](spark, small)
    assert df.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    if name in oracle.SQL:
        assert compare.differences(df, oracle.SQL[name], con) == ""
    else:
        assert df.count() > 0
