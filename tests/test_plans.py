"""Plans: what must not shuffle does not, filters do not repeat work, scans read what they need."""

import re

import pytest
from pyspark.sql import functions as F

from thornwall.operators import detect as D
from thornwall.operators import guard as G
from thornwall.operators import report as RP
from thornwall.operators import sanitize as S
from thornwall.operators.analyze import analyze
from thornwall.plans.queries import QUERIES
from thornwall.sources import content as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_scan_operators_are_map_only(docs):
    content = C.from_text(docs, F.col("doc_id").cast("string"))
    for df in (D.detect(docs), D.segments(docs, "text", ("doc_id",)), S.rescore(docs), G.guard(docs, "text"), analyze(content)):
        assert "Exchange" not in plan(df)


def test_filters_on_results_do_not_repeat_the_scan(docs):
    scored = D.detect(docs, segments=False)
    once = plan(scored).count("RLIKE")
    assert plan(scored.filter("injection_score >= 60")).count("RLIKE") == once
    guarded = G.decide(docs, "text", "strict")
    replaced = plan(guarded).count("regexp_replace")
    assert plan(guarded.filter("sanitization_action = 'BLOCKED'")).count("regexp_replace") == replaced


def test_filters_on_input_columns_reach_the_scan(docs):
    for df in (D.detect(docs), S.rescore(docs), G.decide(docs, "text")):
        assert "EqualTo(lang,en)" in plan(df.filter("lang = 'en'"))


def test_one_conversation_with_most_turns_spreads_over_all_tasks(spark):
    turns = spark.range(40000).select(
        F.when(F.col("id") < 30000, 0).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.lit("x").alias("text"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in G.conversation_prompts(turns).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1.3 * 20000 / 8


def test_unused_results_are_not_computed(docs):
    slim = plan(D.detect(docs).select("doc_id", "injection_score"))
    assert "regexp_extract_all" not in slim
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in slim
    content = C.from_text(docs, F.col("doc_id").cast("string"))
    listed = plan(RP.list_reports(analyze(RP.first_items(content, 3), segments=False), total=F.lit(1)))
    # plans read from the result down to the table: the ids are picked below the rules
    below = listed[listed.rindex("RLIKE") :]
    assert "Exchange" not in listed and "Filter cast(doc_id" in below


def test_small_scores_do_not_read_texts(spark, sf):
    for name in ("extraction_score", "metadata_score"):
        text = plan(QUERIES[name](spark, sf))
        assert "RLIKE" not in text and "text:string" not in text
    assert plan(QUERIES["drift_score"](spark, sf)).count("RLIKE") < 20


def test_guards_without_answers_do_not_join(spark, sf):
    for name in ("guard_detect", "guard_action", "guard_patterns", "compliance_tags", "guard_blocked_message"):
        assert "Join" not in plan(QUERIES[name](spark, sf))


def test_counts_need_no_positions(spark, sf):
    text = plan(QUERIES["report"](spark, sf))
    assert "split(" not in text and "Join" not in text


def test_stored_probabilities_meet_numbers_not_texts(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["model_score"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.index("Join") < text.index("RLIKE")


def test_answers_join_on_conversation_and_turn(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(G.conversation_prompts(turns))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert all(keys.startswith("conv_id") for keys in dealt) and sum("block" in keys for keys in dealt) >= 2
    # turns meet by conversation and block; by conversation alone only what is carried from block to block does
    alone = [line for line in text.splitlines() if "Window [" in line and "block#" not in line.split("[", 2)[2].split("]")[0].split("windowspec")[0]]
    assert all("head" in line for line in text.splitlines() if "Window [lead" in line) and len(alone) <= 2


#: Answers and running values are found by windows over blocks of turns, see tests/test_keyed.py.
BY_BLOCKS = ("guard_audit", "conversation_escalation")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_") and n not in ("analysis_sink", "report_lookup", *BY_BLOCKS)])
def test_no_query_has_a_cross_join_or_window(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Window [" not in text
