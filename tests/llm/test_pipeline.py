import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strataq.llm import decontaminate, secrets, toxicity  # noqa: E402

from .test_near_copies import plain_kept  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark, tmp_path):
    """Each stage's decisions, from the operators' own scores, applied row by row."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        path = f"file:{tmp_path}/{name}"
        out.write.parquet(path)
        after, before = spark.read.parquet(path), docs
        ids = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            machine = toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert ids == {r.doc_id for r in toxicity.score_toxicity(before, machine).filter(F.col("score") < 0.7).collect()}
        elif name == "near-duplicates":
            assert sorted(ids) == plain_kept([(r.doc_id, r.text) for r in before.collect()]) and after.count() == len(ids)
        elif name == "decontamination":
            found = decontaminate.find_contaminated(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert ids == {r.doc_id for r in before.collect()} - {r.doc_id for r in found.collect()}
        else:
            assert after.count() == before.count() and secrets.find_secrets(after).filter("size(secret_spans) > 0").count() == 0
            assert after.filter("n_chars != char_length(text)").count() == before.filter("n_chars != char_length(text)").count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("d")).filter("d != 0").count() == 0


def test_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "y"), (1, "", "en", "s", 0, "y"), (2, "password: abcdefgh " * 3, "en", "s", 57, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        docs_out = stage(spark, docs, FOLDER)
        assert docs_out.count() >= 2
