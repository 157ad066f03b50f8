import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "123 456", "en", "s", 7), (None, "plain words that nobody else has written here at all", "en", "s", 5)], docs.schema)
    now = docs.union(odd).union(docs.limit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == corpus_pipeline.COLUMNS, name
        assert now.filter("doc_id >= 9000").count() == 0 and now.filter("doc_id IS NULL").count() == 1, name
    assert now.count() > 0.8 * n
    assert now.groupBy("doc_id").count().filter("count > 1").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.select("doc_id").distinct().count() == now.count()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_documents(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_near_copies_by_row_not_by_key(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    word = lambda n: " ".join(f"{n}word{i}" for i in range(60))
    rows = [(1, word("a")), (1, word("b")), (1, word("c")), (2, word("c")), (None, word("b")), (None, word("d")), (None, word("d").upper()), (None, word("e")), (0, word("f")), (0, word("f"))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], schema)
    kept = sorted((str(r["doc_id"]), r["text"][:2].lower()) for r in corpus_pipeline.near_copies_out(spark, docs, SF).collect())
    assert kept == [("0", "fw"), ("1", "aw"), ("1", "bw"), ("1", "cw"), ("None", "dw"), ("None", "ew")]
