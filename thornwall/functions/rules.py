"""The rule set as data, and its translation to JVM regular expressions.

Rules are written in the notation of Python's ``re``, because their text is part of the results
(segment reasons, hiding methods). ``jvm_regex`` turns them into a Java pattern that accepts the
same matches, including on non-ASCII text, and that stays fast on long documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    weight: float
    # Words that must all occur in the folded text before the pattern can match.
    needs: tuple[str, ...]


# --- Fixed values: types, rules and weights of detection --------------------------------------

PATTERN_TYPES = (
    "jailbreak",
    "role_override",
    "instruction_hijack",
    "encoded_payload",
    "system_prompt_leak",
    "context_manipulation",
)

DETECTION_RULES = (
    Rule("jailbreak", r"\bignore\b.*?\bprevious\b.*?\binstructions?\b", 0.95, ("ignore", "instruction", "previous")),
    Rule("jailbreak", r"\bdisregard\b.*?\b(?:safety|rules?|guidelines?)\b", 0.95, ("disregard",)),
    Rule("jailbreak", r"\bjailbreak\b", 1.0, ("jailbreak",)),
    Rule("jailbreak", r"\bDAN\s*mode\b", 1.0, ("dan", "mode")),
    Rule("jailbreak", r"\bdo\s+anything\s+now\b", 0.90, ("anything", "now")),
    Rule("role_override", r"\byou\s+are\s+now\b", 0.80, ("you", "now")),
    Rule("role_override", r"\bforget\s+everything\b", 0.90, ("forget", "everything")),
    Rule("role_override", r"\bact\s+as\b.*?\bwithout\b", 0.80, ("without", "act")),
    Rule("role_override", r"\byou\s+are\s+an\s+AI\s+that\s+can\b", 0.75, ("that", "you", "can")),
    Rule("instruction_hijack", r"\bnew\s+instructions?\b", 0.75, ("instruction", "new")),
    Rule("instruction_hijack", r"\boverride\b.*?\bprevious\b", 0.85, ("override", "previous")),
    Rule("instruction_hijack", r"\b(?:admin|system)\s*override\b", 0.95, ("override",)),
    Rule("instruction_hijack", r"\bimportant\s*:\s*ignore\b", 0.80, ("ignore", "important")),
    Rule("system_prompt_leak", r"\brepeat\b.*?\bsystem\s*prompt\b", 0.95, ("prompt", "repeat")),
    Rule("system_prompt_leak", r"\bshow\b.*?\bhidden\s*prompt\b", 0.95, ("prompt", "hidden")),
    Rule("system_prompt_leak", r"\bprint\b.*?\binstructions\b", 0.85, ("instruction", "print")),
)

# --- Fixed values: fallback keywords and known attack phrases ----------------------------------

KEYWORDS = ("ignore", "override", "forget", "pretend", "system", "admin")

# The last word of the third phrase has capitals, so it never equals a word of lower-cased text.
ATTACK_PHRASES = (
    "ignore all previous instructions",
    "disregard safety guidelines",
    "you are an unrestricted AI",
)


@dataclass(frozen=True)
class SanitizeRule:
    pattern: str
    marker: str
    needs: tuple[str, ...]


# --- Fixed values: sanitise rules and markers --------------------------------------------------

SANITIZE_RULES = (
    SanitizeRule(
        r"\bignore\s+(?:all\s+)?previous\s+instructions?\b",
        "[FILTERED: instruction override attempt]",
        ("ignore", "previous", "instruction"),
    ),
    SanitizeRule(
        r"\bdisregard\s+(?:the\s+)?(?:above|safety|rules?)\b",
        "[FILTERED: safety bypass attempt]",
        ("disregard",),
    ),
    SanitizeRule(r"\bjailbreak\b", "[FILTERED]", ("jailbreak",)),
    SanitizeRule(r"\bDAN\s*mode\b", "[FILTERED]", ("dan", "mode")),
    SanitizeRule(r"\bforget\s+everything\b", "[FILTERED: memory manipulation]", ("forget", "everything")),
    SanitizeRule(r"\byou\s+are\s+now\b", "[FILTERED: role change attempt]", ("you", "now")),
    SanitizeRule(r"\bsystem\s*:\s*override\b", "[FILTERED: system override]", ("system", "override")),
    SanitizeRule(r"\badmin\s*:\s*", "[FILTERED: admin impersonation]", ("admin",)),
)
STRICT_MARKER = "[BLOCKED]"
PLAIN_MARKER = "[REMOVED]"
CUSTOM_MARKER = "[CUSTOM_FILTER]"
PERMISSIVE_WARNING = "Permissive mode - content passed without modification"

# --- Fixed values: HTML rules ------------------------------------------------------------------

HIDDEN_STYLES = (
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"opacity\s*:\s*0(?:\s|;|$)",
    r"height\s*:\s*0",
    r"width\s*:\s*0",
    r"font-size\s*:\s*0",
    r"color\s*:\s*(?:transparent|rgba\(.*?,\s*0\))",
    r"position\s*:\s*absolute.*?(?:left|top)\s*:\s*-\d+",
)
HIDDEN_CLASSES = r"hidden|invisible|sr-only"
SCRIPT_SIGNS = (
    r"eval\s*\(",
    r"document\.write",
    r"innerHTML\s*=",
    r"outerHTML\s*=",
    r"\.src\s*=",
    r"atob\s*\(",
    r"btoa\s*\(",
    r"fromCharCode",
    r"\\x[0-9a-fA-F]{2}",
    r"\\u[0-9a-fA-F]{4}",
)
INDICATORS = (
    r"ignore\s+(?:all\s+)?previous",
    r"disregard\s+(?:the\s+)?above",
    r"new\s+instructions?",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"user\s*:\s*",
    r"override\s+(?:safety|security)",
    r"jailbreak",
    r"DAN\s+mode",
)
# An indicator is "high" if its own text names one of these words, otherwise "medium".
HIGH_INDICATOR_WORDS = ("override", "jailbreak")

# --- Fixed values: text patterns ---------------------------------------------------------------

URL_PATTERN = r'https?://[^\s<>"{}|\\^`\[\]]+'
ENCODING_PATTERNS = {
    "has_base64": r"[A-Za-z0-9+/]{20,}={0,2}",
    "has_hex": r"(?:\\x[0-9a-fA-F]{2}){3,}",
    "has_unicode_escapes": r"(?:\\u[0-9a-fA-F]{4}){2,}",
    "has_url_encoding": r"(?:%[0-9a-fA-F]{2}){3,}",
}
# Applied as plain text: the first two and last two are written with a backslash on purpose.
TRIGGER_ESCAPES = ((r"\n", " "), (r"\r", " "), ("```", "` ` `"), (r"<\|", "< |"), (r"\|>", "| >"))
# The same table read as the patterns it looks like.
TRIGGER_ESCAPES_INTENDED = (("\n", " "), ("\r", " "), ("```", "` ` `"), ("<|", "< |"), ("|>", "| >"))


# --- Translation to Java -------------------------------------------------------------------------

# Contents of character classes with the meaning Python gives them.
_WIDE_SPACES = (0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = r"\t-\r\x1c-\x20\x85\xa0" + "".join(
    f"\\u{c:04x}" if isinstance(c, int) else f"\\u{c[0]:04x}-\\u{c[1]:04x}" for c in _WIDE_SPACES
)
WORD = r"\p{L}\p{N}_"
_CLASSES = {"s": SPACE, "w": WORD, "d": r"\p{Nd}"}
_AFTER_WORD = f"(?![{WORD}])"
_BEFORE_WORD = f"(?<![{WORD}])"
_ANY_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _tokens(pattern: str) -> list[str]:
    return re.findall(r"\\.|.", pattern, re.DOTALL)


def _word_start(rest: list[str]) -> tuple[str, int]:
    """Java text for a word edge before ``rest``, and how many tokens of ``rest`` it consumed.

    Testing the edge after the literal lets the JVM reject most positions on their first character.
    """
    letters = 0
    while letters < len(rest) and rest[letters].isalpha():
        letters += 1
    if letters < len(rest) and rest[letters] in "?*+{":
        letters -= 1
    if letters > 0:
        word = "".join(rest[:letters])
        return f"{word}(?<![{WORD}]{word})", letters
    alternatives = re.match(r"\(\?:([a-z]\w*\??(?:\|[a-z]\w*\??)*)\)", "".join(rest))
    if alternatives:
        first = "".join(sorted({word[0] for word in alternatives.group(1).split("|")}))
        return f"(?=[{first}]){_BEFORE_WORD}", 0
    return _BEFORE_WORD, 0


def _translate(pattern: str, literal_first: bool = True) -> str:
    out: list[str] = []
    tokens = _tokens(pattern)
    inside_class = False
    i = 0
    while i < len(tokens):
        token = tokens[i]
        if token == "\\b" and not inside_class:
            following = tokens[i + 1] if i + 1 < len(tokens) else ""
            preceding = tokens[i - 1] if i else ""
            if not literal_first:
                out.append(_ANY_EDGE)
            elif following.isalnum() or following == "(":
                text, used = _word_start(tokens[i + 1 :])
                out.append(text)
                i += used
            else:
                out.append(_AFTER_WORD if preceding.isalnum() or preceding in ("?", ")") else _ANY_EDGE)
        elif len(token) == 2 and token[0] == "\\" and token[1] in _CLASSES:
            out.append(_CLASSES[token[1]] if inside_class else f"[{_CLASSES[token[1]]}]")
        elif len(token) == 2 and token[0] == "\\" and token[1].lower() in _CLASSES and not inside_class:
            out.append(f"[^{_CLASSES[token[1].lower()]}]")
        elif token == "\\Z":
            out.append("\\z")
        elif inside_class and token in ("[", "&"):
            out.append("\\" + token)
        else:
            if token == "[" and not inside_class:
                inside_class = True
            elif token == "]" and inside_class and out[-1] not in ("[", "^"):
                inside_class = False
            out.append(token)
        i += 1
    return "".join(out)


def jvm_regex(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern with the matches of a rule of this module."""
    # d: only \n ends a line; i + u: ignore case for all of Unicode
    return ("(?idu)" if ignore_case else "(?d)") + _translate(pattern)


def _gapped(pattern: str) -> list[str]:
    """The parts of a rule around its lazy gaps; a single part where a gap lies in a group."""
    parts = pattern.split(".*?")
    return [pattern] if {"(", "["} & set(_tokens(parts[0])) else parts


def _lower(pattern: str) -> str:
    return "".join(t if t.startswith("\\") else t.lower() for t in _tokens(pattern))


# In a rule with gaps, part follows part on one line. If the nearest next part is not followed by the
# rest, no farther one is; and of all openings that end on a line, the first has a match if any has. So
# every part may be atomic, and a line may be given up after its first opening: the cost of a rule is one
# pass over the text, where plain backtracking grows with the square of the openings or worse.
# An opening with white space in it may begin on one line and end on the next. It counts for the line
# where it ends, so it is tried even where the line on which it begins has been given up.

_LINE_SPACE = SPACE.replace(r"\t-\r", r"\t\x0b-\r")


def _crossing(head: str) -> str | None:
    """A Java look-ahead for an opening (in Java notation) that crosses the end of a line, if it can."""
    if SPACE not in head:
        return None
    return f"(?={head})(?!{head.replace(SPACE, _LINE_SPACE)})"


def _search(pattern: str, flags: str) -> str:
    head, *rest = [_translate(p) for p in _gapped(pattern)]
    if not rest:
        return f"(?{flags}){head}"
    tail = "".join(f"(?>.*?{p})" for p in rest)
    crossing = _crossing(head)
    return f"(?m{flags})^(?>.*?{head}){tail}" + (f"|{crossing}{head}{tail}" if crossing else "")


def search_regexes(pattern: str) -> list[str]:
    """Java patterns for the original text; the rule matches somewhere if one of them does."""
    group = re.fullmatch(r"([^()|]*)\(\?:(.*\.\*\?.*)\)", pattern)
    if group is None:
        return [_search(pattern, "idu")]
    return [_search(group.group(1) + option, "idu") for option in group.group(2).split("|")]


def folded_search_regex(pattern: str) -> str:
    """A Java pattern that finds whether a rule matches in text that ``fold_lower_sql`` has folded."""
    return _search(_lower(pattern), "d")


def folded_spans_regex(pattern: str) -> str:
    """A Java pattern whose first group is, where set, a match of the rule in folded text.

    Where the group is not set, it has passed over an opening without a match and the rest of its line.
    """
    head, *rest = [_translate(p) for p in _gapped(_lower(pattern))]
    if not rest:
        return f"(?d)({head})"
    crossing = _crossing(head)
    given_up = f"(?>.*?(?={crossing})|.*)" if crossing else ".*"
    return f"(?d)({head}" + "".join(f"(?>.*?{p})" for p in rest) + f")|{head}{given_up}"


# What Java is trusted with in a user pattern: ASCII letters and signs, escaped signs, the three classes,
# the dot, quantifiers of one such item, word edges, and groups of alternatives that are not repeated. Java
# recurses on repeated groups and reads names, braces, brackets and flags in its own way.
_ITEM = r"""(?:[A-Za-z0-9_ ,;:!@%=~'"<>/-]|\\[swd]|\\[!-/:-@\[-`{-~]|\.)(?:[*+?]\??)?"""
_PLAIN = re.compile(rf"(?:{_ITEM}(?![*+?{{])|\\b(?![*+?{{])|\||\(\?:|\)(?![*+?{{]))*")


def user_regex(pattern: str) -> str | None:
    """A Java pattern with the matches of a valid user pattern, or None where Python has to run it."""
    if not _PLAIN.fullmatch(pattern) or re.search(pattern, "", re.IGNORECASE):
        return None
    return "(?idu)" + _translate(pattern, literal_first=False)
