"""The whole analysis: extracted content in, one result row per item out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwall.config import DEFAULT, ScanConfig
from thornwall.functions import safety as S
from thornwall.functions.matching import computed_once
from thornwall.functions.text import head
from thornwall.operators.detect import detect, risk_category


def with_safety(
    df: DataFrame,
    injection: str = "injection_score",
    embedding: str = "embedding_score",
    config: ScanConfig = DEFAULT,
) -> DataFrame:
    """Add component scores, ``safety_score``, ``recommended_action`` and the constant ``confidence``.

    Missing flag or metadata columns read as "not set". ``safety_score`` is rounded half-up to two
    decimals, ``safety_score_exact`` to four (no further decimal exists); the action uses the exact one.
    """

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)

    def value(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    extraction = S.extraction_score(flag("has_hidden_text"), flag("has_hidden_divs"), flag("has_suspicious_scripts"))
    drift = S.drift_score(F.col(embedding))
    metadata = S.metadata_score(
        flag("has_metadata"), value("source", "string"), value("user_reputation", "int")
    )
    df = df.withColumns(
        {
            "extraction_quality": F.round(extraction, 2),
            "detection_safety": F.round(F.lit(100.0) - F.col(injection), 2),
            "embedding_drift": F.round(drift, 2),
            "metadata_risk": F.round(metadata, 2),
            "__tw_safety": S.unrounded_safety(extraction, F.col(injection), drift, metadata, config),
        }
    )
    return df.withColumns(
        {
            "safety_score": F.round("__tw_safety", 2),
            "safety_score_exact": F.round("__tw_safety", 4),
            "recommended_action": S.recommended_action(F.col("__tw_safety"), config),
            "safety_confidence": F.lit(S.CONFIDENCE),
        }
    ).drop("__tw_safety")


def scan_text(config: ScanConfig) -> Column:
    """The text that counts: visible text, and alt texts and comments too where hidden content is scored."""
    if not config.score_hidden:
        return F.col("raw_text")
    return F.concat_ws(" ", "raw_text", F.array_join("alt_texts", " "), F.array_join("comments", " "))


def analyze(
    content: DataFrame,
    model_probability: str | None = None,
    config: ScanConfig = DEFAULT,
    segments: bool | str = True,
) -> DataFrame:
    """Analyse extracted content (see ``thornwall.sources.content``).

    One row per item with scores, category, action, breakdown and flagged segments. The id is the
    content id, so a rerun writes the same rows. Map-only: no row leaves its task. ``segments="count"``
    gives the number of segments instead of the segments.
    """
    df = content.withColumn("__tw_scan", scan_text(config))
    df = detect(df, "__tw_scan", "ocr_text", model_probability, config, segments)
    df = with_safety(df, config=config)
    columns = [
        F.col("content_id").alias("analysis_id"),
        "content_type",
        "content_hash",
        head(F.col("raw_text"), config.raw_text_limit).alias("raw_text"),
        head(F.col("ocr_text"), config.ocr_text_limit).alias("ocr_text"),
        "char_count",
        "ocr_confidence",
        "has_hidden_text",
        "has_hidden_divs",
        "has_suspicious_scripts",
        "alt_texts",
        "simulated",
        "injection_score",
        risk_category(F.col("injection_score"), config).alias("risk_category"),
        "safety_score",
        "safety_score_exact",
        "recommended_action",
        "pattern_score",
        "model_score",
        "embedding_score",
        "anomaly_score",
        "extraction_quality",
        "detection_safety",
        "embedding_drift",
        "metadata_risk",
        "safety_confidence",
        "confidence_scores",
        "ml_enabled",
    ]
    listed = {"count": ["flagged_segments_count"], True: ["flagged_segments"], False: []}[segments]
    return df.select(*columns, *listed)
