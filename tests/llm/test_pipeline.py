import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.test_duplicates import classes, slow_print
from thornwall.llm import decontam, lines, simhash
from thornwall.llm.common import written


def test_stages_one_after_the_other(spark):
    folder = "/root/testdata/sf0.01"
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, folder), name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == start.columns
    toxic = seen["line_dedup"].count()
    assert 0.8 * start.count() < toxic <= start.count()
    # line dedup keeps all documents, and no long line stays in two of them
    kept = seen["near_dedup"]
    assert kept.count() == toxic
    key = F.lower(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    lined = kept.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", key).where("length(key) >= 12")
    assert lined.groupBy("key").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").count() == 0
    assert kept.where("n_chars <> length(text)").count() == 0
    # of every class one document stays, as plain comparison of all pairs says
    prints = {r.doc_id: slow_print(r.text) for r in kept.collect()}
    left = {r.doc_id for r in seen["decontamination"].select("doc_id").collect()}
    assert left == set(classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3).values())
    # no document left holds an item
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontam.contamination(seen["packing"], benchmark).where("contaminated").count() == 0
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == seen["packing"].count()


def test_odd_rows_and_an_empty_corpus(spark, odd, none):
    folder = "/root/testdata/sf0.001"
    for docs in (odd, none):
        rows = docs.count()
        for name, stage in pipeline.STAGES:
            before, docs = docs, written(stage(spark, docs, folder), name)
            if name != "packing":
                assert docs.columns == odd.columns and docs.count() <= before.count()
            if name == "near_dedup":  # of the null ids all stay, of the others no id twice but with texts of their own
                assert docs.where("doc_id is null").count() == before.where("doc_id is null").count()
                assert docs.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 1").count() == 0
        assert (docs.count() > 0) == (rows > 0)


def test_stages_take_columns_with_any_names(spark, odd):
    names = ["doc_id", "text", "line_id", "line_keep", "bad", "row", "__id", "__node"]
    docs = odd.toDF(*names)
    benchmark = spark.createDataFrame([(1, odd.where("doc_id = 5").first().text)], "item_id long, text string")
    kept = lines.deduplicate_lines(docs)
    assert kept.columns == names and kept.count() == docs.count()
    assert simhash.deduplicate(docs).columns == names
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == names and 0 < clean.count() < docs.count()
