"""Slow, plain Python readings of the rules, for small inputs."""

import random
import re

from thornwall.functions import rules as R


def segments(text):
    """(start, end, text, type) of every rule match, searched in the lower-cased text."""
    low = text.lower()
    return [
        (m.start(), m.end(), text[m.start() : m.end()], rule.kind)
        for rule in R.DETECTION_RULES
        for m in re.finditer(rule.pattern, low, re.IGNORECASE)
    ]


def signals(text):
    if not text:
        return 0.0, 0.0, 0.0, 0.0
    low = text.lower()
    pattern = max([r.weight for r in R.DETECTION_RULES if re.search(r.pattern, low, re.IGNORECASE)], default=0.0)
    keyword = min(0.8, 0.1 + 0.15 * sum(k in low for k in R.KEYWORDS))
    words = set(low.split())
    overlap = max(len(words & set(p.split())) / len(p.split()) for p in R.ATTACK_PHRASES)
    share = sum(not (c.isalnum() or c.isspace()) for c in text) / len(text)
    anomaly = (0.1 if len(text) > 5000 else 0) + (0.2 if share > 0.3 else 0.1 if share > 0.15 else 0)
    return pattern, keyword, overlap, anomaly


def score(text):
    p, m, e, a = signals(text)
    return round(min(100, 100 * (0.45 * p + 0.35 * m + 0.10 * e + 0.10 * a)), 2)


def sanitized(text, marker_of, custom=()):
    """Text after all rules, and the replaced pieces in the order of the result."""
    found = []
    steps = [(r.pattern, marker_of(r)) for r in R.SANITIZE_RULES] + [(c, R.CUSTOM_MARKER) for c in custom]
    for pattern, marker in steps:
        matches = list(re.finditer(pattern, text, re.IGNORECASE))
        found += [(m.group(), marker, m.start(), m.end()) for m in reversed(matches)]
        text = re.sub(pattern, lambda m: marker, text, flags=re.IGNORECASE)
    return text, found


_WORDS = (
    "ignore previous instructions instruction disregard safety rules guideline jailbreak DAN mode do anything now you are "
    "forget everything act as without an AI that can new override admin system important repeat prompt show hidden print "
    "all the above pretend x_y Ignore JAILBREAK jaİlbreak ſystem ıgnore forgeT eVerything K2 naïve été 中文 ½ ²"
).split()
_GLUE = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\r\n", ":", ": ", " : ", "", "-", "_", "\u0301", "\U0001f600", "."]


def random_texts(count, seed, longest=14):
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        pieces = []
        for _ in range(rng.randint(1, longest)):
            pieces += [rng.choice(_WORDS), rng.choice(_GLUE)]
        texts.append("".join(pieces))
    return texts
