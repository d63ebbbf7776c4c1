"""HTML extraction over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwall.functions import html as H
from thornwall.functions.matching import computed_once, with_folded


def extract(
    df: DataFrame,
    html: str = "html",
    mode: str = "regex",
    extract_alt_text: bool = True,
    detect_hidden: bool = True,
    all_entities: bool = True,
) -> DataFrame:
    """Add everything that can be read from a page.

    ``regex`` mode works with built-in functions on the raw page. ``dom`` mode parses elements:
    text of hidden elements counts as visible, comments and ``noscript`` do not, alt texts come from
    images only, and hidden content lists elements instead of style patterns.
    """
    df = df.withColumn("__tw_page", F.coalesce(F.col(html), F.lit("")))
    df = with_folded(df, "__tw_page", "__tw_page_fold")
    page = F.col("__tw_page")
    no_texts = F.array().cast("array<string>")
    no_hidden = F.array().cast(H.HIDDEN_TYPE)
    if mode == "dom":
        df = df.withColumn("__tw_dom", H.dom(page))
        dom = F.col("__tw_dom")
        text, title = dom["visible_text"], dom["title"]
        alts = dom["alt_texts"] if extract_alt_text else no_texts
        hidden = dom["hidden"] if detect_hidden else no_hidden
    elif mode == "regex":
        df = H.with_visible_text(df, "__tw_page", "__tw_text", all_entities)
        text, title = F.col("__tw_text"), F.lit(None).cast("string")
        alts = H.alt_texts(page) if extract_alt_text else no_texts
        hidden = H.hidden_styles("__tw_page", "__tw_page_fold") if detect_hidden else no_texts
    else:
        raise ValueError(f"unknown mode {mode!r}")
    df = df.withColumns({"visible_text": text, "title": title, "alt_texts": alts, "hidden_content": hidden})
    df = df.withColumns(
        {
            "suspicious_scripts": H.suspicious_scripts("__tw_page"),
            "base64_content": H.base64_content(page),
            "has_hidden_divs": F.size("hidden_content") > 0,
        }
    )
    all_text = F.concat(F.col("visible_text"), F.lit(" "), F.array_join("alt_texts", " "))
    df = df.withColumn("has_suspicious_scripts", F.size("suspicious_scripts") > 0)
    return _with_indicators(df, all_text).drop("__tw_dom", "__tw_page", "__tw_page_fold", "__tw_text")


def _with_indicators(df: DataFrame, text: Column) -> DataFrame:
    df = with_folded(df.withColumn("__tw_all", text), "__tw_all", "__tw_fold")
    df = df.withColumn("injection_indicators", H.injection_indicators("__tw_all", "__tw_fold"))
    return df.drop("__tw_all", "__tw_fold")


def hidden_elements(df: DataFrame, keep: tuple[str, ...], html: str = "html") -> DataFrame:
    """One row per hidden element."""
    found = df.select(*keep, F.posexplode(H.hidden_elements(html)).alias("element_no", "element"))
    return found.select(*keep, "element_no", "element.*")


def scripts(df: DataFrame, keep: tuple[str, ...], html: str = "html") -> DataFrame:
    """One row per suspicious script."""
    found = df.select(*keep, F.posexplode(H.suspicious_scripts(html)).alias("script_no", "script"))
    return found.select(*keep, "script_no", "script.*")


def base64_runs(df: DataFrame, keep: tuple[str, ...], html: str = "html") -> DataFrame:
    """One row per base64 run (the first five of a page)."""
    found = df.select(*keep, F.posexplode(H.base64_content(F.col(html))).alias("run_no", "run"))
    return found.select(*keep, "run_no", "run.*")


def indicators(df: DataFrame, text: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row per injection indicator in a text."""
    df = _with_indicators(df, text)
    found = df.select(*keep, F.posexplode("injection_indicators").alias("indicator_no", "indicator"))
    return found.select(*keep, "indicator_no", "indicator.*")


def extract_for_scan(df: DataFrame, html: str, mode: str = "regex") -> DataFrame:
    """The columns that scoring a page needs, each evaluated once; ``mode`` as in ``extract``."""
    df = df.withColumn("__tw_page", F.coalesce(F.col(html), F.lit("")))
    scripts_found = F.size(H.suspicious_scripts("__tw_page")) > 0
    if mode == "dom":
        df = df.withColumn("__tw_dom", H.dom(F.when(F.col(html).isNotNull(), F.col("__tw_page"))))
        dom = F.col("__tw_dom")
        columns = {
            "raw_text": F.coalesce(dom["visible_text"], F.lit("")),
            "has_hidden_divs": F.coalesce(F.size(dom["hidden"]) > 0, F.lit(False)),
            "has_suspicious_scripts": scripts_found,
            "alt_texts": F.coalesce(dom["alt_texts"], F.array().cast("array<string>")),
        }
        return computed_once(df, columns).drop("__tw_page", "__tw_dom")
    if mode != "regex":
        raise ValueError(f"unknown mode {mode!r}")
    df = H.with_visible_text(df, "__tw_page", "raw_text")
    df = with_folded(df, "__tw_page", "__tw_page_fold")
    columns = {
        "has_hidden_divs": F.size(H.hidden_styles("__tw_page", "__tw_page_fold")) > 0,
        "has_suspicious_scripts": scripts_found,
        "alt_texts": H.alt_texts(F.col("__tw_page")),
    }
    return computed_once(df, columns).drop("__tw_page", "__tw_page_fold")
