"""Every registered query of the package over the smallest tables, and with extra columns and no rows."""

import pytest

import __spark_entry__ as entry
from tremolite.llm.queries import QUERIES

COLUMNS = {
    "op1_clause_grammar": "doc_id held_out score predicted", "op2_qgram_bands": "doc_id item_id edits start end",
    "op3_ngram_jaccard": "doc_id n_shingles component_id n_links",
    "op4_secret_worklist": "doc_id n_assign n_access n_hex base_sha256 spans n_layers",
    "op5_virtual_slots": "doc_id size text_crc32 law shard slot grown_shard virtual_slot",
    "op6_disclosure": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_weak_labels": "doc_id posterior score kept",
    "op8_hashed_ngrams": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score",
    "op9_grouping_genetic": "doc_id piece start length ids_crc32 sequence_id offset", "op10_crf_language": "doc_id held_out lang_pred score",
    "op11_band_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_slice_codes": "vec_id code error label_error codebooks_sha256", "op13_source_mix": "doc_id size source_size target taken source copies",
}


def test_all_are_registered():
    assert COLUMNS.keys() == QUERIES.keys() and COLUMNS.keys() | {"pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(COLUMNS[name].split())
    table = "embeddings" if name == "op12_slice_codes" else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert df.count() == n if name not in ("op2_qgram_bands", "op9_grouping_genetic", "op11_band_trie") else df.count() >= 1
