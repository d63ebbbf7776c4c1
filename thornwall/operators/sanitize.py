"""Sanitising: matched payloads replaced by markers, rule after rule."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from thornwall.config import DEFAULT, ScanConfig
from thornwall.functions import rules as R
from thornwall.functions.matching import computed_once, contains_all_sql, quoted, spans_sql, with_folded
from thornwall.functions.slices import slices
from thornwall.functions.text import head
from thornwall.operators.detect import score

log = logging.getLogger(__name__)

SEGMENT_TYPE = "array<struct<original:string,sanitized:string,start:int,end:int,action:string,reason:string>>"
MODES = ("strict", "balanced", "permissive")

_T = "__tws_"


def _column(value: str | bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _segments_sql(stage: str, pattern: str, marker: str, reason: str) -> str:
    """The replacements of one rule; the last match is replaced, and listed, first."""
    return (
        f"reverse(transform({spans_sql(stage, stage, pattern)}, s_ -> named_struct('original', s_.text, "
        f"'sanitized', {marker}, 'start', s_.start, 'end', s_.end, 'action', 'replaced', 'reason', {quoted(reason)})))"
    )


def valid_patterns(patterns: list[str]) -> list[str]:
    """The patterns that compile; the others are logged and skipped."""
    usable = []
    for pattern in patterns:
        try:
            re.compile(pattern)
            usable.append(pattern)
        except re.error:
            log.warning("invalid custom pattern skipped: %s", pattern)
    return usable


_NAMES = ("original", "sanitized", "start", "end", "action", "reason")
_ARROW = pa.struct(
    [
        ("text", pa.string()),
        ("modified", pa.int32()),
        ("segments", pa.list_(pa.struct([(n, pa.int32() if n in ("start", "end") else pa.string()) for n in _NAMES]))),
    ]
)
_CUSTOM = from_arrow_type(_ARROW)


@lru_cache(maxsize=1024)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None


def _change(text: str, span: tuple[int, int]) -> tuple:
    return (text[slice(*span)], R.CUSTOM_MARKER, *span, "replaced", "Custom pattern match")


def _filtered(text: str, patterns, listed: bool) -> dict:
    """Text with the matches of each pattern in turn replaced, their number, and the replacements in the order of the result."""
    modified, changes = 0, []
    for pattern in filter(None, map(_compiled, patterns)):
        spans = [match.span() for match in pattern.finditer(text)]
        modified += len(spans)
        if listed:
            changes.extend(dict(zip(_NAMES, _change(text, span))) for span in spans[::-1])
        if spans:
            text = pattern.sub(lambda _: R.CUSTOM_MARKER, text)
    return {"text": text, "modified": modified, "segments": changes if listed else None}


def _replaced(batches: Iterator[tuple[pa.Array, pa.Array]], listed: bool) -> Iterator[pa.Array]:
    """The rows of ``_filtered``, a slice at a time: the replacements of all rows of a batch would be many times its size."""
    for texts, patterns in batches:
        for first, many in slices(texts):
            rows = zip(texts.slice(first, many).to_pylist(), patterns.slice(first, many).to_pylist(), strict=True)
            yield pa.array([None if t is None or p is None else _filtered(t, p, listed) for t, p in rows], _ARROW)


@F.arrow_udf(_CUSTOM)
def _custom(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Patterns that Python has to run: those of single rows, and those outside what Java is trusted with."""
    return _replaced(batches, listed=True)


@F.arrow_udf(_CUSTOM)
def _custom_counts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """As ``_custom``, with the number of the replacements and not the replacements."""
    return _replaced(batches, listed=False)


def sanitize(
    df: DataFrame,
    text: str = "text",
    mode: str | Column = "balanced",
    custom_patterns: list[str] | str | None = None,
    preserve_semantics: bool | Column = True,
    segments: bool = True,
) -> DataFrame:
    """Add ``sanitized_content``, ``segments_modified``, ``warnings`` and the ``sanitized_segments``.

    ``mode`` (strict, balanced, permissive) and ``preserve_semantics`` may be columns, so a batch can
    hold requests of every kind. ``custom_patterns`` is a list for the whole job (run by the
    JVM), or the name of a column with the patterns of each row (only rows that have any go to Python).
    Each rule works on the output of the one before it.
    """
    if isinstance(mode, str) and mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    before = df.columns
    df = df.withColumns(
        {
            _T + "0": F.coalesce(F.col(text), F.lit("")),
            _T + "mode": _column(mode),
            _T + "keep": _column(preserve_semantics),
        }
    )
    # No marker contains a word that a later rule needs, so the words of the original decide.
    active = F.col(_T + "mode") != "permissive"
    df = df.withColumn(_T + "wanted", F.when(active, F.col(_T + "0")))
    df = with_folded(df, _T + "wanted", _T + "folded")
    stages = []

    steps: list[tuple[str, str, str, str]] = []  # condition, marker, Java pattern and reason of each stage
    for rule in R.SANITIZE_RULES:
        marker = (
            f"case when {_T}mode = 'strict' then '{R.STRICT_MARKER}' when {_T}keep then '{rule.marker}' "
            f"else '{R.PLAIN_MARKER}' end"
        )
        condition = f"coalesce({contains_all_sql(_T + 'folded', rule.needs)}, false)"
        reason = f"Matched dangerous pattern: {rule.pattern[:30]}..."
        steps.append((condition, marker, R.jvm_regex(rule.pattern), reason))
    in_python: Column | None = F.col(custom_patterns) if isinstance(custom_patterns, str) else None
    if isinstance(custom_patterns, list):
        usable = valid_patterns(custom_patterns)
        java_forms = [R.user_regex(p) for p in usable]
        if None in java_forms:
            in_python = F.array(*[F.lit(p) for p in usable])
        else:
            always = f"{_T}mode <> 'permissive'"
            steps += [(always, f"'{R.CUSTOM_MARKER}'", java, "Custom pattern match") for java in java_forms]

    none = f"cast(array() as {SEGMENT_TYPE})"
    counts, lists = [], []
    for i, (condition, marker, java, reason) in enumerate(steps):
        stage = f"{_T}{i}"
        if segments:
            lists.append(F.expr(f"if({condition}, {_segments_sql(stage, java, marker, reason)}, {none})"))
        counts.append(F.expr(f"if({condition}, regexp_count({stage}, {quoted(java)}), 0)"))
        replaced = f"regexp_replace({stage}, {quoted(java)}, {marker})"
        stages.append(f"if({condition}, {replaced}, {stage}) as {_T}{i + 1}")
    df = df.selectExpr("*", *stages)  # each stage names the one before it
    stage = F.col(f"{_T}{len(steps)}")

    last = stage
    if in_python is not None:
        wanted = active & (F.size(in_python) > 0)
        df = df.withColumn(_T + "custom", (_custom if segments else _custom_counts)(F.when(wanted, stage), in_python))
        custom = F.col(_T + "custom")
        last = F.coalesce(custom["text"], stage)
        counts.append(F.coalesce(custom["modified"], F.lit(0)))
        if segments:
            lists.append(F.coalesce(custom["segments"], F.array().cast(SEGMENT_TYPE)))

    total = counts[0]
    for count in counts[1:]:
        total = total + count
    warnings = F.when(active, F.array().cast("array<string>")).otherwise(F.array(F.lit(R.PERMISSIVE_WARNING)))
    result = {"sanitized_content": last, "segments_modified": total, "warnings": warnings}
    if segments:
        result["sanitized_segments"] = F.flatten(F.array(*lists))
    df = computed_once(df, result)
    return df.select(*before, *result)


def segment_rows(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per replacement of a table that ``sanitize`` has produced."""
    found = df.select(*keep, F.posexplode("sanitized_segments").alias("segment_no", "segment"))
    return found.select(*keep, "segment_no", "segment.*")


def action_taken(mode: Column, original_risk: Column, modified: Column, config: ScanConfig = DEFAULT) -> Column:
    """What a request's result is called. A strict request below the threshold passes even if changed."""
    risky = original_risk >= config.medium_from
    return (
        F.when((mode == "strict") & risky, F.lit("BLOCKED"))
        .when((mode == "balanced") & (modified > 0), F.lit("SCRUBBED"))
        .when((mode == "permissive") & risky, F.lit("WARNED"))
        .otherwise(F.lit("PASSED"))
    )


def rescore(
    df: DataFrame,
    text: str = "text",
    mode: str | Column = "balanced",
    custom_patterns: list[str] | str | None = None,
    preserve_semantics: bool | Column = True,
    segments: bool = False,
    config: ScanConfig = DEFAULT,
) -> DataFrame:
    """Sanitise and score before and after.

    Adds to ``sanitize``: original_content (cut), original_risk_score, post_sanitization_risk_score,
    risk_reduction and action_taken. Only changed text is scored a second time.
    """
    before = df.columns
    df = sanitize(df, text, mode, custom_patterns, preserve_semantics, segments)
    df = score(df, text, "original_risk_score", config)
    df = df.withColumn("__twr_changed", F.when(F.col("segments_modified") > 0, F.col("sanitized_content")))
    df = score(df, "__twr_changed", "__twr_score", config)
    changed = F.col("segments_modified") > 0
    df = df.withColumn(
        "post_sanitization_risk_score",
        F.when(changed, F.col("__twr_score")).otherwise(F.col("original_risk_score")),
    )
    reduction = F.round(F.col("original_risk_score") - F.col("post_sanitization_risk_score"), 2)
    df = df.withColumns(
        {
            "original_content": head(F.coalesce(F.col(text), F.lit("")), 500),
            "risk_reduction": F.greatest(F.lit(0.0), reduction),
            "action_taken": action_taken(
                _column(mode), F.col("original_risk_score"), F.col("segments_modified"), config
            ),
        }
    )
    added = [
        "original_content", "sanitized_content", "segments_modified", "warnings", "original_risk_score",
        "post_sanitization_risk_score", "risk_reduction", "action_taken",
    ]
    return df.select(*[c for c in before if c not in added], *added, *(["sanitized_segments"] if segments else []))


def batch(requests: DataFrame, config: ScanConfig = DEFAULT) -> DataFrame:
    """Requests with their own mode: columns content, mode, and optionally custom_patterns, preserve_semantics."""
    names = requests.columns
    keep = F.coalesce(F.col("preserve_semantics"), F.lit(True)) if "preserve_semantics" in names else True
    patterns = "custom_patterns" if "custom_patterns" in names else None
    mode = F.coalesce(F.col("mode"), F.lit("balanced"))
    return rescore(requests, "content", mode, patterns, keep, segments=True, config=config)
