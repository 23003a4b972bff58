"""The pipeline's stages, each against a brute-force version on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from sensorloom.llm import decontaminate, pii
from test_exact import plain_components, plain_matches


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), None) if name == "mixing" else spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        seen[name] = len(after)
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "jaccard_join":
            assert set(after) == {i for i, _, c in plain_components([(i, r["text"]) for i, r in before.items()], 5, 80, 100) if i == c}
        if name == "decontamination":
            index = decontaminate.indexes(spark.read.parquet(f"{sf}/benchmark.parquet"))[0]
            assert set(before) - set(after) == {i for i, _ in plain_matches(index, [(i, r["text"]) for i, r in before.items()])}
        if name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
                assert r["text"] == before[i]["text"] or pii.TRIGGER.search(before[i]["text"])
        if name == "mixing":
            assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in after.values()) and set(after) <= set(before)
    assert seen["jaccard_join"] < seen["language_id"] and seen["decontamination"] < seen["jaccard_join"]


def test_run_reads_no_rows_into_an_error(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_columns_of_its_own_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.concat(F.lit("own "), "doc_id")).withColumn("rejected", F.lit(7)).withColumn("row", F.lit("r"))
    out = corpus_pipeline.identified(spark, docs, sf)
    assert out.columns == docs.columns and out.schema["score"].dataType.simpleString() == "string"
    assert all(r["score"] == f"own {r['doc_id']}" and r["rejected"] == 7 and r["row"] == "r" for r in out.collect())
