"""Matches with exact positions, from built-in functions only.

Functions that end in ``_sql`` return SQL text for ``F.expr``: one rule set makes thousands of
expression nodes, and text reaches the JVM in one call where a node costs one each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"

# Matches per block. Sums run within blocks and then over blocks, so a document with very many
# matches costs far less than the square of their number.
_BLOCK = 256


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold_lower_sql(lowered: str) -> str:
    """Lower-cased text with the two letters that equal an ASCII letter when case is ignored."""
    rare = f"contains({lowered}, 'ſ') or contains({lowered}, 'ı')"
    return f"if({rare}, replace(replace({lowered}, 'ſ', 's'), 'ı', 'i'), {lowered})"


def with_folded(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add folded text for rules that match before lower-casing, where capital dotted I is an i too."""
    df = df.selectExpr("*", f"lower(if(contains({text}, 'İ'), replace({text}, 'İ', 'i'), {text})) as __tw_low")
    return df.selectExpr("*", f"{fold_lower_sql('__tw_low')} as {into}").drop("__tw_low")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    A plain projection would let a later filter on one of these columns move below it and evaluate
    the whole expression a second time; filters do not move below a generator that makes the column.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def contains_all_sql(text: str, words: tuple[str, ...]) -> str:
    return " and ".join(f"contains({text}, {quoted(w)})" for w in words)


def spans_sql(original: str, searched: str, java_pattern: str, grouped: bool = False) -> str:
    """All non-overlapping matches of a pattern in ``searched`` as (start, end, text).

    With ``grouped``, only matches in which the pattern's first group is set count.

    Positions count characters of ``searched``; ``text`` is cut from ``original`` at those positions.
    Both are column names. The pattern must not match empty text: match i starts after i + 1 gaps and
    i matches, and both come from splitting the text at the pattern.
    """
    pattern = quoted(java_pattern)
    none = f"cast(array() as {SPAN_TYPE})"
    found = (
        f"named_struct('lengths', transform(regexp_extract_all({searched}, {pattern}, 0), m_ -> char_length(m_)), "
        f"'gaps', transform(split({searched}, {pattern}, -1), g_ -> char_length(g_))"
        + (f", 'real', regexp_extract_all({searched}, {pattern}, 1))" if grouped else ")")
    )
    steps = (
        f"zip_with(slice(f_.gaps, s_ + 1, least({_BLOCK}, size(f_.lengths) - s_)), slice(f_.lengths, s_ + 1, {_BLOCK}), "
        "(g_, l_) -> named_struct('gap', g_, 'length', l_))"
    )
    blocks = (
        f"transform(transform(sequence(0, size(f_.lengths) - 1, {_BLOCK}), s_ -> {steps}), b_ -> "
        "named_struct('steps', b_, 'size', aggregate(b_, 0, (t_, x_) -> t_ + x_.gap + x_.length)))"
    )
    starts = (
        "aggregate(bs_, named_struct('at', 0, 'out', cast(array() as array<int>)), "
        "(a_, b_) -> named_struct('at', a_.at + b_.size, 'out', array_append(a_.out, a_.at)), a_ -> a_.out)"
    )
    span = (
        "named_struct('start', base_ + a_.at + x_.gap, 'end', base_ + a_.at + x_.gap + x_.length, "
        "'text', substring(a_.piece, a_.at + x_.gap + 1, x_.length))"
    )
    inside = (
        f"aggregate(b_.steps, named_struct('at', 0, 'piece', substring({original}, base_ + 1, b_.size), 'out', {none}), "
        f"(a_, x_) -> named_struct('at', a_.at + x_.gap + x_.length, 'piece', a_.piece, 'out', array_append(a_.out, {span})), "
        "a_ -> a_.out)"
    )
    placed = f"transform(array({blocks}), bs_ -> flatten(zip_with(bs_, {starts}, (b_, base_) -> {inside})))[0]"
    if grouped:
        placed = f"array_compact(zip_with({placed}, f_.real, (s_, r_) -> if(r_ = '', null, s_)))"
    return f"transform(array({found}), f_ -> if(size(f_.lengths) = 0, {none}, {placed}))[0]"
