"""Scalar text functions over a column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thornwall.functions import rules as R
from thornwall.functions.matching import bind

_SPACE_BUT_BLANK = R.SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends; lone blanks are not touched."""
    runs = rf"[{_SPACE_BUT_BLANK}][{R.SPACE}]*|\x20[{R.SPACE}]+"
    return F.trim(F.regexp_replace(text, runs, " "))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normalize_text(text: Column) -> Column:
    """NFKC form with white space collapsed. Only non-ASCII text is sent to Python."""
    normal = F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text)
    return collapse_space(normal)


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(R.jvm_regex(R.URL_PATTERN, ignore_case=False)), F.lit(0))


def encoding_flags(text: Column) -> dict[str, Column]:
    flags = {}
    for name, pattern in R.ENCODING_PATTERNS.items():
        java = R.jvm_regex(pattern, ignore_case=False)
        if name == "has_base64":
            # a long enough run has one that starts where the run starts
            java = java.replace("(?d)", "(?d)(?<![A-Za-z0-9+/])", 1)
        flags[name] = F.rlike(text, F.lit(java))
    return flags


def truncate_display(text: Column, max_length: int = 200) -> Column:
    cut = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    return F.when(F.char_length(text) <= max_length, text).otherwise(cut)


def head(text: Column, length: int, suffix: str = "") -> Column:
    """The first characters, followed by a suffix where something was cut."""
    cut = F.substring(text, 1, length)
    return F.when(F.char_length(text) > length, F.concat(cut, F.lit(suffix)) if suffix else cut).otherwise(text)


def escape_llm_triggers(text: Column, mode: str = "compat") -> Column:
    """Neutralise trigger sequences. ``compat`` reads the table as plain text, ``intended`` as patterns."""
    table = {"compat": R.TRIGGER_ESCAPES, "intended": R.TRIGGER_ESCAPES_INTENDED}[mode]
    for old, new in table:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def encode_base64(content: Column) -> Column:
    """Base64 in one line (sessions may be set to break it every 76 characters)."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def decode_bytes(content: Column) -> Column:
    """UTF-8 bytes as text without the invalid ones; a genuine U+FFFD goes only where others are invalid."""
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def data_url_metadata(image: Column) -> Column:
    """What a data URL says about its image: type, encoded size, estimated decoded size."""
    is_url = F.startswith(image, F.lit("data:image"))
    parts = F.split(image, ",")
    mime = F.split_part(F.split_part(parts[0], F.lit(":"), F.lit(2)), F.lit(";"), F.lit(1))
    data = F.when(is_url, F.coalesce(F.get(parts, 1), F.lit(""))).otherwise(image)
    return F.struct(
        F.when(is_url, mime).otherwise(F.lit("unknown")).alias("mime_type"),
        F.char_length(image).alias("encoded_size"),
        bind(F.char_length(data), lambda n: F.floor(n * 3 / 4).cast("int")).alias("estimated_decoded_size"),
        F.lit(False).alias("has_exif"),
        F.lit(True).alias("format_valid"),
    )
