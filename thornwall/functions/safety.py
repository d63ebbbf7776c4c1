"""Safety score: extraction quality, detection, drift and metadata combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thornwall.config import DEFAULT, ScanConfig

CONFIDENCE = 0.85


def _penalty(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def extraction_score(has_hidden_text: Column, has_hidden_divs: Column, has_suspicious_scripts: Column) -> Column:
    penalties = (
        _penalty(has_hidden_text, 20.0) + _penalty(has_hidden_divs, 15.0) + _penalty(has_suspicious_scripts, 25.0)
    )
    return F.greatest(F.lit(0.0), F.lit(90.0) - penalties)


def drift_score(embedding_score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - embedding_score)


def metadata_score(has_metadata: Column, source: Column, user_reputation: Column) -> Column:
    known = F.lit(90.0) - _penalty(source == "unknown", 20.0) - _penalty(user_reputation < 50, 15.0)
    return F.when(F.coalesce(has_metadata, F.lit(False)), F.greatest(F.lit(0.0), known)).otherwise(F.lit(80.0))


def unrounded_safety(
    extraction: Column, injection: Column, drift: Column, metadata: Column, config: ScanConfig = DEFAULT
) -> Column:
    weighted = (
        extraction * config.extraction_weight
        + (F.lit(100.0) - injection) * config.detection_weight
        + drift * config.drift_weight
        + metadata * config.metadata_weight
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted))


def recommended_action(unrounded: Column, config: ScanConfig = DEFAULT) -> Column:
    return (
        F.when(unrounded >= config.pass_from, F.lit("PASS"))
        .when(unrounded >= config.warn_from, F.lit("PASS_WITH_WARNINGS"))
        .otherwise(F.lit("BLOCK"))
    )
