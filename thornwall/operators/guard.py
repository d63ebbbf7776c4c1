"""Prompt guard: scan prompts, sanitise the risky ones, and write an audit row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwall.config import DEFAULT, ScanConfig
from thornwall.functions.matching import computed_once
from thornwall.functions.text import content_hash, head
from thornwall.operators import detect as D
from thornwall.operators.keyed import next_answers
from thornwall.operators.sanitize import sanitize


def scan(df: DataFrame, prompt: str = "prompt", config: ScanConfig = DEFAULT) -> DataFrame:
    """Add injection_score, risk_category, injection_detected and the sorted flagged_patterns."""
    df = D.with_signals(df, D.combined_text(prompt, None))
    kinds = D.type_score_columns()
    hits = F.array_compact(F.array(*[F.when(s > 0, F.lit(k)) for k, s in kinds.items()]))
    df = df.withColumns({"injection_score": D.injection_score(config), "flagged_patterns": F.array_sort(hits)})
    df = df.withColumns(
        {
            "risk_category": D.risk_category(F.col("injection_score"), config),
            "injection_detected": F.col("injection_score") >= config.guard_from,
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("__tw_")])


def blocked_message(score: Column, category: Column, config: ScanConfig = DEFAULT) -> Column:
    """The answer to a blocked prompt. Its wording and the tags below are fixed values."""
    return F.concat(
        F.lit(
            "[REQUEST BLOCKED]\n"
            f"This request was blocked by {config.service_name} due to detected prompt injection patterns.\n"
            "Risk Score: "
        ),
        score.cast("string"),
        F.lit("/100\nRisk Category: "),
        category,
        F.lit("\nPlease review your input and remove any suspicious content."),
    )


def compliance_tags(score: Column, was_sanitized: Column, action: Column, config: ScanConfig = DEFAULT) -> Column:
    return F.array_compact(
        F.array(
            F.when(score < config.guard_from, F.lit("ISO42001_COMPLIANT")),
            F.when(was_sanitized, F.lit("NIST_AI_RMF_SANITIZED")),
            F.when(action != "BLOCKED", F.lit("SOCI_PASS")),
            F.lit("AUDIT_TRAIL_COMPLETE"),
        )
    )


def decide(
    df: DataFrame, prompt: str = "prompt", mode: str | Column = "balanced", config: ScanConfig = DEFAULT
) -> DataFrame:
    """Scan and, where an injection is detected, sanitise: adds sanitized_prompt, was_sanitized, sanitization_action."""
    before = df.columns
    df = scan(df, prompt, config)
    scanned = df.columns
    text = F.coalesce(F.col(prompt), F.lit(""))
    df = df.withColumns(
        {
            "__twg_risky": F.when(F.col("injection_detected"), text),
            "__twg_mode": mode if isinstance(mode, Column) else F.lit(mode),
        }
    )
    df = sanitize(df, "__twg_risky", F.col("__twg_mode"), segments=False)
    changed = F.col("segments_modified") > 0
    strict = F.col("__twg_mode") == "strict"
    action = (
        F.when(~F.col("injection_detected"), F.lit("PASSED"))
        .when(changed & strict, F.lit("BLOCKED"))
        .when(changed, F.lit("SCRUBBED"))
        .otherwise(F.lit("PASSED_WITH_WARNING"))
    )
    added = {
        "sanitized_prompt": F.when(changed, F.col("sanitized_content")).otherwise(text),
        "was_sanitized": changed,
        "sanitization_action": action,
    }
    df = df.withColumns(added)
    return df.select(*[c for c in scanned if c not in added], *added)


def guard(
    df: DataFrame,
    prompt: str = "prompt",
    mode: str | Column = "balanced",
    response: str | None = None,
    config: ScanConfig = DEFAULT,
) -> DataFrame:
    """The guard's result with its audit columns.

    ``response`` names the column with the model's answer (null reads as empty); a blocked prompt
    gets the blocked message instead. Hashes cover the full prompt and the full answer.
    """
    keys = [c for c in df.columns if c not in (prompt, response)]
    answer = F.lit("") if response is None else F.coalesce(F.col(response), F.lit(""))
    df = decide(df, prompt, mode, config)
    blocked = F.col("sanitization_action") == "BLOCKED"
    full = F.coalesce(F.col(prompt), F.lit(""))
    df = df.withColumn(
        "llm_response",
        F.when(blocked, blocked_message(F.col("injection_score"), F.col("risk_category"), config)).otherwise(answer),
    )
    cut = config.audit_text_limit
    return df.select(
        *keys,
        "injection_detected",
        "injection_score",
        "risk_category",
        "flagged_patterns",
        "was_sanitized",
        "sanitization_action",
        head(full, 500).alias("original_prompt"),
        head(F.col("sanitized_prompt"), 500).alias("sanitized_prompt"),
        "llm_response",
        head(full, cut, "...").alias("audit_original_prompt"),
        head(F.col("sanitized_prompt"), cut, "...").alias("audit_sanitized_prompt"),
        content_hash(full).alias("input_hash"),
        content_hash(F.col("llm_response")).alias("output_hash"),
        compliance_tags(
            F.col("injection_score"), F.col("was_sanitized"), F.col("sanitization_action"), config
        ).alias("compliance_tags"),
    )


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that answers each: the next turn of the conversation, whatever its number."""
    return next_answers(turns)


def stats(guarded: DataFrame, *by: str) -> DataFrame:
    """Totals per group and over all: requests, threats, blocked, sanitized, passed, average score.

    Scores have two decimals, so they are summed as whole hundredths and the average is exact whatever
    the order. Groups are counted once; the coarser levels of the rollup add up those counts.
    """
    cents = F.round(F.col("injection_score") * 100).cast("bigint")
    action = F.col("sanitization_action")
    counts = {
        "total_requests": F.count(F.lit(1)),
        "threats_detected": F.count_if(F.col("injection_detected")),
        "requests_blocked": F.count_if(action == "BLOCKED"),
        "requests_sanitized": F.count_if(F.col("was_sanitized")),
        "requests_passed": F.count_if(action.startswith("PASSED")),
        "cents": F.sum(cents),
    }
    fine = guarded.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
    if by:
        fine = fine.rollup(*by).agg(*[F.sum(n).alias(n) for n in counts])
    average = F.coalesce(F.round(F.col("cents") / (F.col("total_requests") * 100.0), 4), F.lit(0.0))
    return fine.withColumn("average_injection_score", average).drop("cents")
