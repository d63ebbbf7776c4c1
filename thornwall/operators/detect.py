"""Detection: rule matches, the four signals and the injection score.

Everything is a narrow projection over the text. The work is laid out in a few stacked projections
so that each costly value (lower-cased text, word flags, the rule mask) is computed once per row:

1. lower case and folded text;
2. one flag per word that decides whether a rule can match at all;
3. a bit mask of the rules that do match (regular expressions run only behind their words);
4. scores, and match positions for the rules in the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwall.config import DEFAULT, ScanConfig
from thornwall.functions import rules as R
from thornwall.functions.matching import computed_once, contains_all_sql, fold_lower_sql, quoted, spans_sql

SEGMENT_TYPE = (
    "array<struct<text:string,start:int,end:int,reason:string,confidence:double,pattern_type:string>>"
)

_T = "__tw_"  # prefix of working columns


def _w(name: str) -> Column:
    return F.col(_T + name)


def _eager_words() -> list[str]:
    words = list(R.KEYWORDS) + [rule.needs[0] for rule in R.DETECTION_RULES]
    return list(dict.fromkeys(words))


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_T)])


def combined_text(text: str, ocr_text: str | None) -> Column:
    """The text that is scanned: text and OCR text joined by a space, nulls read as empty."""
    base = F.coalesce(F.col(text), F.lit(""))
    if ocr_text is None:
        return base
    extra = F.coalesce(F.col(ocr_text), F.lit(""))
    return F.when(extra != "", F.concat(base, F.lit(" "), extra)).otherwise(base)


def _rule_mask() -> Column:
    bits = []
    for i, rule in enumerate(R.DETECTION_RULES):
        hit = f"{_T}has_{rule.needs[0]}"
        if len(rule.needs) > 1:
            hit += f" and {contains_all_sql(_T + 'folded', rule.needs[1:])}"
        hit += f" and rlike({_T}folded, {quoted(R.folded_search_regex(rule.pattern))})"
        bits.append(f"if({hit}, {1 << i}, 0)")
    return F.expr(" | ".join(bits))


def _mask_of(condition) -> int:
    return sum(1 << i for i, rule in enumerate(R.DETECTION_RULES) if condition(rule))


def _highest_weight(rules_mask: int) -> Column:
    """The highest weight among the matched rules of a set, found from the mask alone."""
    weights = sorted({r.weight for i, r in enumerate(R.DETECTION_RULES) if rules_mask >> i & 1}, reverse=True)
    if not weights:
        return F.lit(0.0)
    cases = []
    for weight in weights:
        bits = rules_mask & _mask_of(lambda r, w=weight: r.weight == w)
        cases.append(f"when {_T}mask & {bits} <> 0 then {weight}d")
    return F.expr(f"case {' '.join(cases)} else 0d end")


def _keyword_part() -> Column:
    terms = [
        f"if({_T}has_{w} and ({_T}same or contains({_T}lower, {quoted(w)})), 0.15d, 0d)" for w in R.KEYWORDS
    ]
    return F.expr(f"least(0.8d, 0.1d + {' + '.join(terms)})")


def _token_present(word: str) -> str:
    """Whether a word stands between white space (or the ends) of the lower-cased text."""
    pattern = f"{word}(?![^{R.SPACE}])(?<![^{R.SPACE}]{word})"
    known = [w for w in _eager_words() if w in word]
    first = f"{_T}has_{known[0]}" if known else f"contains({_T}lower, {quoted(word)})"
    usual = f"contains({_T}lower, {quoted(f' {word} ')})"
    return f"{first} and ({usual} or rlike({_T}lower, {quoted(pattern)}))"


def _overlap_part() -> Column:
    """Largest share of the words of one known attack phrase that occur in the text."""
    shares = []
    for phrase in R.ATTACK_PHRASES:
        words = sorted(set(phrase.split()))
        found = [f"if({_token_present(w)}, 1, 0)" for w in words if w == w.lower()]
        shares.append(f"({' + '.join(found)}) / {len(words)}")
    return F.expr(f"greatest({', '.join(shares)})")


def _special_count() -> Column:
    """Characters that are neither letter, digit nor space.

    The first pass leaves little behind and uses a class of three parts only, which the JVM tests far
    faster than the full list of spaces; the second takes the other spaces out of the rest.
    """
    rest = F.regexp_replace(_w("text"), r"[\p{L}\p{N} ]+", "")
    return F.char_length(F.regexp_replace(rest, f"[{R.SPACE}]+", ""))


def _anomaly_part() -> Column:
    """Length above 5000, and the share of special characters."""
    length = F.char_length(_w("text"))
    share = _w("special") / length
    long_part = F.when(length > 5000, F.lit(0.1)).otherwise(F.lit(0.0))
    special_part = F.when(share > 0.3, F.lit(0.2)).when(share > 0.15, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.when(length == 0, F.lit(0.0)).otherwise(F.least(long_part + special_part, F.lit(0.5)))


def _with_flags(df: DataFrame, text: Column) -> DataFrame:
    """Text, lower-cased text, folded text and word flags; each column builds on the ones before it."""
    return df.withColumn(_T + "text", text).selectExpr(
        "*",
        f"lower({_T}text) as {_T}lower",
        f"{fold_lower_sql(_T + 'lower')} as {_T}folded",
        f"{_T}lower = {_T}folded as {_T}same",
        *[f"contains({_T}folded, {quoted(w)}) as {_T}has_{w}" for w in _eager_words()],
    )


def with_rule_mask(df: DataFrame, text: Column) -> DataFrame:
    """Working columns up to the rule mask, for callers that need matches but no score."""
    return computed_once(_with_flags(df, text), {_T + "mask": _rule_mask()})


SIGNALS = ("pattern", "model", "embedding", "anomaly")


def with_signals(
    df: DataFrame,
    text: Column,
    model_probability: Column | None = None,
    wanted: tuple[str, ...] = SIGNALS,
) -> DataFrame:
    """Working columns with the raw signals, each from 0 to 1 (all 0 for empty text)."""
    df = _with_flags(df, text)
    empty = _w("text") == ""
    zero = F.lit(0.0)
    once = {}
    if "pattern" in wanted:
        once[_T + "mask"] = _rule_mask()
    if "model" in wanted:
        model = _keyword_part()
        if model_probability is not None:
            model = F.coalesce(model_probability.cast("double"), model)
        once[_T + "model"] = F.when(empty, zero).otherwise(model)
    if "embedding" in wanted:
        once[_T + "embedding"] = F.when(empty, zero).otherwise(_overlap_part())
    if "anomaly" in wanted:
        df = df.withColumn(_T + "special", _special_count())
        once[_T + "anomaly"] = _anomaly_part()
    df = computed_once(df, once)
    if "pattern" in wanted:
        df = df.withColumn(_T + "pattern", _highest_weight(_mask_of(lambda r: True)))
    return df


def injection_score(config: ScanConfig = DEFAULT) -> Column:
    weighted = (
        _w("pattern") * config.pattern_weight
        + _w("model") * config.model_weight
        + _w("embedding") * config.embedding_weight
        + _w("anomaly") * config.anomaly_weight
    )
    return F.round(F.least(F.lit(100.0), weighted * 100), 2)


def type_score_columns() -> dict[str, Column]:
    return {t: _highest_weight(_mask_of(lambda r, t=t: r.kind == t)) for t in R.PATTERN_TYPES}


def _rule_segments(rule: R.Rule) -> str:
    found = spans_sql(_T + "text", _T + "folded", R.folded_spans_regex(rule.pattern), grouped=True)
    return (
        f"transform({found}, s_ -> named_struct('text', s_.text, 'start', s_.start, 'end', s_.end, "
        f"'reason', 'Matched {rule.kind} pattern', 'confidence', {rule.weight}d, 'pattern_type', '{rule.kind}'))"
    )


def flagged_segments() -> Column:
    """Every match of every matched rule, by rule and then position."""
    none = f"cast(array() as {SEGMENT_TYPE})"
    parts = [
        f"if({_T}mask & {1 << i} <> 0, {_rule_segments(rule)}, {none})" for i, rule in enumerate(R.DETECTION_RULES)
    ]
    return F.expr(f"if({_T}mask = 0, {none}, flatten(array({', '.join(parts)})))")


def segment_count() -> Column:
    """How many segments ``flagged_segments`` would list, without their positions."""
    parts = []
    for i, rule in enumerate(R.DETECTION_RULES):
        found = f"regexp_extract_all({_T}folded, {quoted(R.folded_spans_regex(rule.pattern))}, 1)"
        parts.append(f"if({_T}mask & {1 << i} <> 0, size(filter({found}, m_ -> m_ <> '')), 0)")
    return F.expr(f"if({_T}mask = 0, 0, {' + '.join(parts)})")


def risk_category(score: Column, config: ScanConfig = DEFAULT) -> Column:
    return (
        F.when(score >= config.critical_from, F.lit("Critical"))
        .when(score >= config.high_from, F.lit("High"))
        .when(score >= config.medium_from, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def detect(
    df: DataFrame,
    text: str = "text",
    ocr_text: str | None = None,
    model_probability: str | None = None,
    config: ScanConfig = DEFAULT,
    segments: bool | str = True,
) -> DataFrame:
    """Add the detection result to every row.

    Adds ``injection_score`` (0 to 100), the breakdown ``pattern_score``, ``model_score``,
    ``embedding_score``, ``anomaly_score`` (each times 100), ``confidence_scores`` (highest weight
    per pattern type), ``ml_enabled`` and, unless switched off, ``flagged_segments``; with ``segments="count"``
    only their number, ``flagged_segments_count``.
    """
    probability = None if model_probability is None else F.col(model_probability)
    df = with_signals(df, combined_text(text, ocr_text), probability)
    kinds = type_score_columns()
    scores = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds.values()))
    none = F.from_json(F.lit("{}"), "map<string,double>")
    columns = {
        "injection_score": injection_score(config),
        "pattern_score": F.round(_w("pattern") * 100, 2),
        "model_score": F.round(_w("model") * 100, 2),
        "embedding_score": F.round(_w("embedding") * 100, 2),
        "anomaly_score": F.round(_w("anomaly") * 100, 2),
        "confidence_scores": F.when(_w("text") == "", none).otherwise(scores),
        "ml_enabled": F.lit(False) if probability is None else probability.isNotNull(),
    }
    if segments == "count":
        columns["flagged_segments_count"] = segment_count()
    elif segments:
        columns["flagged_segments"] = flagged_segments()
    return _drop(df.withColumns(columns))


def score(df: DataFrame, text: str, into: str, config: ScanConfig = DEFAULT) -> DataFrame:
    """Add only the injection score of a text column."""
    df = with_signals(df, combined_text(text, None))
    return _drop(df.withColumn(into, injection_score(config)))


def segments(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per flagged segment, in the order of the result (``segment_no`` from 0).

    Rows without a match drop out before any position is computed.
    """
    df = with_rule_mask(df, combined_text(text, None)).filter(_w("mask") != 0)
    df = df.select(*keep, F.posexplode(flagged_segments()).alias("segment_no", "segment"))
    return df.select(*keep, "segment_no", "segment.*")


def type_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one column per pattern type with the highest weight matched."""
    df = with_rule_mask(df, combined_text(text, None))
    return _drop(df.withColumns(type_score_columns()))


def raw_signals(df: DataFrame, text: str = "text", wanted: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Add signals from 0 to 1: ``pattern``, ``model`` (keywords), ``embedding`` (overlap), ``anomaly``."""
    df = with_signals(df, combined_text(text, None), wanted=wanted)
    return _drop(df.withColumns({n: _w(n) for n in wanted}))


def combined(df: DataFrame, model_probability: str, config: ScanConfig = DEFAULT) -> DataFrame:
    """The scores of rows that ``raw_signals`` has read, with a model's probability in place of the keywords.

    The text need not be there any more; a null probability leaves the keyword score.
    """
    probability = F.col(model_probability).cast("double")
    df = df.withColumns({_T + n: F.col(n) for n in SIGNALS if n != "model"})
    silent = F.col("model") == 0  # only empty text has no keyword score at all
    df = df.withColumn(_T + "model", F.when(silent, F.lit(0.0)).otherwise(F.coalesce(probability, F.col("model"))))
    columns = {
        "injection_score": injection_score(config),
        "model_score": F.round(_w("model") * 100, 2),
        "ml_enabled": probability.isNotNull(),
    }
    return _drop(df.withColumns(columns))


def segment_severity(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.8, F.lit("critical"))
        .when(confidence >= 0.6, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
