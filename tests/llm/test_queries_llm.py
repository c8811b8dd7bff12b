"""Registered queries on the smallest tables: SQL where there is some, the contract's columns for all."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_sanitise_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
                        "spans string",
    "op2_cover_tree_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_factorisation_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_lsh_forest_join": "doc_id bigint, class_id bigint, text_id bigint, n_links bigint, kept boolean",
    "op5_wavelet_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op8_arc_to_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_crf_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, spans string",
    "op10_best_fit_packing": "doc_id bigint, piece bigint, start bigint, size bigint, block bigint, bin bigint, "
                             "offset bigint, capacity bigint",
    "op11_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_phrase_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                                   "contaminated boolean",
    "pipeline": "doc_id bigint, piece bigint, start bigint, size bigint, block bigint, bin bigint, offset bigint, "
                "capacity bigint",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == COLUMNS[name]
    if name in entry.oracle_sql():
        assert differences(df, duck(SF), entry.oracle_sql()[name]) == []
    else:
        table = "embeddings" if name.startswith("op2") else "documents"
        given = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert df.count() >= given * (0.5 if name == "pipeline" else 1)
