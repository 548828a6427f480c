"""The registered queries over whole tables: SQL twins where they exist, else columns and row counts; the pipeline's stages."""

import pytest
from check_results import connect, duck_rows, spark_rows
from texts import DOCS, clash, prose

import corpus_pipeline
from regrove.llm import registered
from regrove.llm.decontaminate import normal_words

SQL = registered.oracle_sql()
COLUMNS = {
    "op1_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_order_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_html_text": ["page_id", "url", "text", "n_chars"],
    "op12_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "pipeline": ["doc_id", "source", "size", "source_size", "target", "copies", "taken"],
}


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf, name):
    found = registered.queries()[name](spark, sf)
    if name in SQL:
        assert spark_rows(found) == duck_rows(connect(sf), SQL[name])
        return
    assert set(COLUMNS[name]) <= set(found.columns)
    if name != "pipeline":
        key, table = {"op10_html_text": ("page_id", "pages"), "op12_embedding_dedup": ("vec_id", "embeddings")}.get(name, ("doc_id", "documents"))
        given = spark.read.parquet(f"{sf}/{table}.parquet").select(key)
        assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in given.collect())


def test_pipeline_stages_take_effect(spark, messy_rows, tmp_path):
    passage = prose(500, 30)
    rows = [*messy_rows, (60, f"{prose(60, 20)} {passage} {prose(61, 20)}", "en", "a", 1), (61, f"{prose(62, 30)} bob@mail.example.org end", "en", "b", 1)]
    insults = [(200 + i, f"{prose(200 + i, 20)} blarg {prose(900 + i, 20)} blarg grumf", "en", "a", 1) for i in range(30)]
    clash(spark.createDataFrame(rows + insults, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0) for r in rows if r[0]] + [(r[0], 1) for r in insults], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {r[0] for r in rows}
    assert set(seen["toxicity"]) == clean
    assert clean - set(seen["near_duplicates"]) == {2, 3, 5, 6}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {60}
    assert set(seen["personal_data"]) == set(seen["decontamination"]) == set(seen["mixing"])
    assert seen["personal_data"][61]["text"].endswith("[EMAIL] end") and seen["personal_data"][61]["n_chars"] == len(seen["personal_data"][61]["text"])
    assert all(seen["personal_data"][i]["text"] == seen["decontamination"][i]["text"] for i in seen["personal_data"] if i not in (12, 61))
    assert normal_words(passage)[0].decode() in passage


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
