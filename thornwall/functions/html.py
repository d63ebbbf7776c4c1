"""HTML functions over a column of raw pages."""

from __future__ import annotations

import html as html_entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from thornwall.functions import rules as R
from thornwall.functions.matching import bind, contains_all_sql, quoted, spans_sql
from thornwall.functions.text import collapse_space

# Where a block is opened but never closed, no later one is closed either. The second alternative then
# takes the whole rest at once (and puts it back), so a page full of openings is still read once.
_SCRIPT_BLOCK = r"(?isu)<script[^>]*>.*?</script>|(<script.*\z)"
_STYLE_BLOCK = r"(?isu)<style[^>]*>.*?</style>|(<style.*\z)"
_SCRIPT_BODY = r"(?isu)<script[^>]*>(.*?)</script>|<script.*\z"

# Entities that built-in functions replace; the ampersand comes last so that nothing is read twice.
_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e in _ENTITIES) + ");)[A-Za-z#]"


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html_entities.unescape, na_action="ignore")


def unescape_common(text: Column) -> Column:
    for entity, character in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def without_blocks(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _SCRIPT_BLOCK, "$1"), _STYLE_BLOCK, "$1")


def _without_tags(html: Column) -> Column:
    """Tags become blanks. No tag ends after the last '>', so the rest is not searched for one."""
    tail = F.substring_index(html, ">", -1)
    start = F.char_length(html) - F.char_length(tail)
    blanked = F.concat(F.regexp_replace(F.substring(html, F.lit(1), start), "<[^>]+>", " "), tail)
    return F.when(F.contains(html, F.lit(">")), blanked).otherwise(html)


def with_visible_text(df: DataFrame, html: str, into: str = "visible_text", all_entities: bool = True) -> DataFrame:
    """Add the text outside tags, scripts and styles, entities decoded and white space collapsed.

    Common entities are decoded by built-in functions. Pages with any other entity go through
    Python's full table, unless ``all_entities`` is off; other pages are not sent to Python.
    """
    df = df.withColumn("__tw_open", without_blocks(F.col(html)))
    df = df.withColumn("__tw_plain", _without_tags(F.col("__tw_open")))
    plain = F.col("__tw_plain")
    decoded = unescape_common(plain)
    if all_entities:
        rare = F.rlike(plain, F.lit(_OTHER_ENTITY))
        df = df.withColumn("__tw_rare", _unescape(F.when(rare, plain)))
        decoded = F.coalesce(F.col("__tw_rare"), decoded)
    return df.withColumn(into, collapse_space(decoded)).drop("__tw_open", "__tw_plain", "__tw_rare")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?isu)<title[^>]*>(.*?)</title>|<title.*\z", 1))


def alt_texts(html: Column, images_only: bool = False) -> Column:
    """Values of ``alt`` attributes anywhere; ``images_only`` drops empty ones and other elements."""
    if images_only:
        pattern = r"<img\s[^>]*?\balt\s*=\s*[\"']([^\"']*)[\"']"
        found = F.regexp_extract_all(html, F.lit(R.jvm_regex(pattern)), F.lit(1))
        return F.filter(found, lambda a: a != "")
    return F.regexp_extract_all(html, F.lit(R.jvm_regex(r"alt\s*=\s*[\"']([^\"']*)[\"']")), F.lit(1))


def _required_words(pattern: str) -> tuple[str, ...]:
    """Words of three letters or more that every match holds: outside optional parts and alternatives."""
    fixed = re.sub(r"\(.*?\)\??|\w\?", " ", pattern.replace("\\s", " ")).lower()
    return tuple(re.findall(r"[a-z]{3,}", fixed))


def _found_sql(text: str, pattern: str) -> str:
    return " or ".join(f"rlike({text}, {quoted(java)})" for java in R.search_regexes(pattern))


def hidden_styles(html: str, folded: str) -> Column:
    """The hiding style patterns that occur anywhere in a page, in rule order.

    Takes the names of two columns: the page, and what ``with_folded`` makes of it.
    """
    cases = [
        f"if({contains_all_sql(folded, _required_words(p))} and ({_found_sql(html, p)}), {quoted(p)}, null)"
        for p in R.HIDDEN_STYLES
    ]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def suspicious_scripts(html: str) -> Column:
    """Scripts with at least one sign, as (snippet, patterns_found)."""
    bodies = f"regexp_extract_all({html}, {quoted(_SCRIPT_BODY)}, 1)"
    cases = [f"if(rlike(b_, {quoted(R.jvm_regex(p))}), {quoted(p)}, null)" for p in R.SCRIPT_SIGNS]
    found = f"array_compact(array({', '.join(cases)}))"
    checked = f"transform({bodies}, b_ -> named_struct('snippet', substring(b_, 1, 200), 'patterns_found', {found}))"
    return F.expr(f"filter({checked}, s_ -> size(s_.patterns_found) > 0)")


def decode_base64_preview(encoded: Column) -> Column:
    """First 100 characters of the decoded text, or a note where the padding is wrong."""

    def decode(data: Column) -> Column:
        rest = F.char_length(data) % 4
        pads = F.char_length(encoded) - F.char_length(data)
        sound = (rest == 0) | ((rest != 1) & (pads >= 4 - rest))
        text = F.make_valid_utf8(F.unbase64(data).cast("string"))
        return F.when(sound, F.substring(text, 1, 100)).otherwise(F.lit("[Unable to decode]"))

    return bind(F.rtrim(encoded, F.lit("=")), decode)


def base64_content(html: Column) -> Column:
    """The first five base64 runs, as (preview, length, decoded_preview)."""
    # A run is only tried from its first character; no match can start later in it.
    pattern = r"(?:data:[^;]+;base64,|(?<![A-Za-z0-9+/]))([A-Za-z0-9+/]{40,}={0,2})"
    found = F.slice(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), 1, 5)
    return F.transform(
        found,
        lambda m: F.struct(
            F.when(F.char_length(m) > 50, F.concat(F.substring(m, 1, 50), F.lit("..."))).otherwise(m).alias("preview"),
            F.char_length(m).alias("length"),
            decode_base64_preview(m).alias("decoded_preview"),
        ),
    )


INDICATOR_TYPE = "array<struct<pattern:string,matched_text:string,position:int,severity:string>>"


def injection_indicators(text: str, folded: str) -> Column:
    """All matches of the indicator patterns, by pattern and then position.

    Takes the names of two columns: the text, and what ``with_folded`` makes of it.
    """
    return F.expr(f"flatten(array({', '.join(_indicator_sql(text, folded, p) for p in R.INDICATORS)}))")


def _indicator_sql(text: str, folded: str, pattern: str) -> str:
    words = _required_words(pattern)
    severity = "high" if any(w in pattern for w in R.HIGH_INDICATOR_WORDS) else "medium"
    found = (
        f"transform({spans_sql(text, text, R.jvm_regex(pattern))}, s_ -> named_struct('pattern', {quoted(pattern)}, "
        f"'matched_text', s_.text, 'position', s_.start, 'severity', '{severity}'))"
    )
    return f"if({contains_all_sql(folded, words)}, {found}, cast(array() as {INDICATOR_TYPE}))"


def strip_dangerous(html: Column) -> Column:
    """Without scripts and inline event handlers, and with script links pointing nowhere."""
    html = F.regexp_replace(html, _SCRIPT_BLOCK, "$1")
    # a run of white space is tried once, from its start
    handler = R.jvm_regex(r"(?<!\s)\s++on\w+\s*=\s*[\"'][^\"']*[\"']")
    html = F.regexp_replace(html, handler, "")
    return F.regexp_replace(html, R.jvm_regex(r"href\s*=\s*[\"']javascript:[^\"']*[\"']"), 'href="#"')


# --- Element level: needs a parser, so it runs in Python on the pages that may qualify ------------

HIDDEN_TYPE = "array<struct<tag:string,text:string,hiding_method:string,full_style:string,class:array<string>>>"
_HIDDEN = ArrayType(
    StructType()
    .add("tag", StringType())
    .add("text", StringType())
    .add("hiding_method", StringType())
    .add("full_style", StringType())
    .add("class", ArrayType(StringType()))
)
_DOM = (
    StructType()
    .add("visible_text", StringType())
    .add("title", StringType())
    .add("alt_texts", ArrayType(StringType()))
    .add("hidden", _HIDDEN)
)

# Elements that never have content.
_VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())
_UNSEEN = frozenset(("script", "style", "noscript", "template"))


class _Page(HTMLParser):
    """Collects the text pieces of a page and, per element of interest, the range it spans.

    Work is in proportion to the page: an end tag is looked up by name, and pieces know by counters whether
    they stand inside something unseen.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[list[str]] = []  # the parts of each piece
        self.seen: list[int] = []  # 0 shown, 1 inside noscript only, 2 unseen
        self.stack: list[tuple[str, int]] = []
        self.depths: dict[str, list[int]] = {}  # open elements by name: their places on the stack
        self.elements: list[list] = []  # tag, attributes, first piece, end piece
        self.alts: list[str] = []
        self._joined = False

    def handle_starttag(self, tag, attrs):
        self._joined = False
        attributes = {name: value or "" for name, value in attrs}
        if tag == "img" and attributes.get("alt"):
            self.alts.append(attributes["alt"])
        element = [tag, attributes, len(self.pieces), None]
        self.elements.append(element)
        if tag in _VOID:
            element[3] = len(self.pieces)
        else:
            self.depths.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, len(self.elements) - 1))

    def handle_endtag(self, tag):
        self._joined = False
        if not self.depths.get(tag):
            return
        depth = self.depths[tag][-1]
        while len(self.stack) > depth:
            name, index = self.stack.pop()
            self.depths[name].pop()
            self.elements[index][3] = len(self.pieces)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_comment(self, data):
        self._joined = False

    def handle_data(self, data):
        if self._joined:
            self.pieces[-1].append(data)
            return
        inside = {name for name in _UNSEEN if self.depths.get(name)}
        self.pieces.append([data])
        self.seen.append(0 if not inside else 1 if inside == {"noscript"} else 2)
        self._joined = True

    def finish(self) -> None:
        """Strip the pieces, and note for each place the next one that holds text, for either reading."""
        self.texts = ["".join(parts).strip() for parts in self.pieces]
        self.next = []
        for most in (0, 1):
            following, after = [0] * len(self.texts), len(self.texts)
            for i in range(len(self.texts) - 1, -1, -1):
                if self.texts[i] and self.seen[i] <= most:
                    after = i
                following[i] = after
            self.next.append(following)

    def text(self, start: int, end: int | None, separator: str, with_noscript: bool, limit: int | None = None) -> str:
        """The text of a range, read only as far as ``limit`` characters need."""
        following, chosen, length = self.next[with_noscript], [], 0
        end = len(self.texts) if end is None else end
        while start < end and (start := following[start]) < end and (limit is None or length < limit):
            chosen.append(self.texts[start])
            length += len(self.texts[start])
            start += 1
        return separator.join(chosen)[:limit]


_STYLES = [(p, re.compile(p, re.IGNORECASE)) for p in R.HIDDEN_STYLES]
_CLASSES = re.compile(R.HIDDEN_CLASSES, re.IGNORECASE)


def _read_page(html: str) -> dict:
    page = _Page()
    page.feed(html)
    page.close()
    page.finish()
    by_style, by_class = [], []
    heading = next((e for e in page.elements if e[0] == "title"), None)
    for tag, attributes, start, end in page.elements:
        style = attributes.get("style")
        method = next((p for p, r in _STYLES if r.search(style)), None) if style is not None else None
        classes = attributes.get("class", "").split()
        named = any(_CLASSES.search(c) for c in classes)
        if method is None and not named:
            continue
        text = page.text(start, end, "", True, 100)
        if text and method is not None:
            by_style.append({"tag": tag, "text": text, "hiding_method": method, "full_style": style[:100], "class": None})
        if text and named:
            by_class.append({"tag": tag, "text": text, "hiding_method": "class_based", "full_style": None, "class": classes})
    return {
        "visible_text": page.text(0, None, " ", False),
        "title": None if heading is None else page.text(heading[2], heading[3], "", True),
        "alt_texts": page.alts,
        "hidden": by_style + by_class,
    }


@F.pandas_udf(_DOM)
def _dom(html: pd.Series) -> pd.DataFrame:
    empty = {"visible_text": None, "title": None, "alt_texts": None, "hidden": None}
    rows = [empty if h is None else _read_page(h) for h in html]
    return pd.DataFrame(rows, columns=["visible_text", "title", "alt_texts", "hidden"])


@F.pandas_udf(_HIDDEN)
def _hidden(html: pd.Series) -> pd.Series:
    return html.map(lambda h: _read_page(h)["hidden"], na_action="ignore")


def dom(html: Column) -> Column:
    """Element-level reading of a page: visible_text, title, alt_texts and hidden elements."""
    return _dom(html)


def may_hide_elements(html: str) -> Column:
    """Pages on which an element can count as hidden (its attribute may be written with entities)."""
    rules = " or ".join(_found_sql(html, p) for p in (*R.HIDDEN_STYLES, R.HIDDEN_CLASSES))
    # a value written with entities, whatever they stand for
    entity = quoted(r"""(?iu)(?:style|class)\s*=\s*(?:"[^"]*&|'[^']*&|[^"'\s][^\s>]*&)""")
    return F.expr(f"{rules} or rlike({html}, {entity})")


def hidden_elements(html: str) -> Column:
    """Elements hidden by inline style, then by class; only candidate pages are sent to Python."""
    found = _hidden(F.when(may_hide_elements(html), F.col(html)))
    return F.coalesce(found, F.array().cast(HIDDEN_TYPE))


# --- Comments: a scanner that knows where a page is not text ---------------------------------------

COMMENT_TYPE = "array<struct<text:string,position:int,closed:boolean>>"
_MARKUP = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag: quotes count after an equals sign only, and one that stays open takes all that follows.
_TAG_REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|)[^>=]*+)*+(?:>|\Z)""")
_COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is text up to their end tag.
_RAW = frozenset("style textarea title xmp iframe noembed noframes".split())
_SCRIPT_PART = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.IGNORECASE)


def _script_end(page: str, at: int) -> int:
    """Where the end tag of a script begins that starts at ``at``; a script inside its comment has an end tag of its own."""
    escaped = inner = False
    for part in _SCRIPT_PART.finditer(page, at):
        if part[0] == "<!--":
            escaped = True
        elif part[0] == "-->":
            escaped = inner = False
        elif part[1]:
            if not inner:
                return part.start()
            inner = False
        elif escaped:
            inner = True
    return len(page)


def find_comments(page: str) -> list[tuple[str, int, bool]]:
    """(text, position, closed) of the comments of a page, in one pass.

    A comment ends with ``-->`` or ``--!>``, ``<!-->`` and ``<!--->`` are empty, one that is not closed takes the rest of the
    page. Inside tags, scripts, styles, titles and other elements of plain text there are no comments.
    """
    found = []
    at = 0
    while mark := _MARKUP.search(page, at):
        if mark[0] == "<!--":
            body = mark.end()
            if page.startswith((">", "->"), body):
                end = at = body + 1 + (page[body] == "-")
                text, closed = "", True
            else:
                close = _COMMENT_END.search(page, body)
                end, at = (close.start(), close.end()) if close else (len(page), len(page))
                text, closed = page[body:end], close is not None
            found.append((text, mark.start(), closed))
            continue
        at = _TAG_REST.match(page, mark.end()).end()
        name = mark[2].lower()
        if mark[1]:
            continue
        if name == "script":
            at = _script_end(page, at)
        elif name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else len(page)
        elif name == "plaintext":
            break
    return found


@F.pandas_udf(
    ArrayType(StructType().add("text", StringType()).add("position", IntegerType()).add("closed", BooleanType()))
)
def _comments(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: None if page is None else [{"text": t, "position": p, "closed": c} for t, p, c in find_comments(page)])


def comments(html: Column) -> Column:
    """The comments of a page as (text, position, closed); only pages that may have one leave the JVM."""
    found = _comments(F.when(F.contains(html, F.lit("<!--")), html))
    return F.coalesce(found, F.array().cast(COMMENT_TYPE))
