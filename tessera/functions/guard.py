"""Guardrail checks on a text: personal data, profanity, injection phrases, links, risk, sanitising."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are applied, words, and weights.
PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email]"),
    ("phone", r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b", "[phone]"),
    ("credit_card_like", r"\b(?:\d[ -]*?){13,16}\b", "[card]"),
)
PROFANITY = ("dumb", "idiot", "stupid")
INJECTION = (
    r"ignore (the )?(previous|above) instructions",
    r"disregard your rules",
    r"reveal your (system|hidden) prompt",
    r"act as (an? )?(administrator|developer|root)",
    r"self-destruct|format drive|exfiltrate",
)
WEIGHTS = {"pii": 0.4, "injection": 0.4, "profanity": 0.1, "links": 0.1}


def _present(pairs: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in pairs]), lambda x: x.isNotNull())


def pii(text: Column) -> Column:
    """Sorted kinds of personal data found."""
    return F.array_sort(_present([(name, text.rlike(rx)) for name, rx, _ in PII]))


def profanity(text: Column) -> Column:
    """Sorted bad words among the text's words."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), F.lower)
    return F.array_sort(F.array_intersect(F.array(*map(F.lit, PROFANITY)), words))


def injection(text: Column) -> Column:
    """The patterns that hit, in order."""
    return _present([(rx, text.rlike(f"(?i){rx}")) for rx in INJECTION])


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"https?://([^/]+)/?", 1))


def unallowed_links(text: Column, allowed: Sequence[str], whole_labels: bool = False) -> Column:
    """URLs whose domain ends with no allowed one; nothing is checked if none is given.

    ``whole_labels`` corrects the plain suffix test: the domain must be an allowed one or below it.
    """
    urls = F.regexp_extract_all(text, F.lit(r"https?://[^\s)]+"), F.lit(0))
    if not allowed:
        return F.filter(urls, lambda u: F.lit(False))

    def passes(d: Column) -> Column:
        tests = [(d == a) | F.endswith(d, F.lit(f".{a}")) if whole_labels else F.endswith(d, F.lit(a)) for a in (x.lower() for x in allowed)]
        return reduce(lambda x, y: x | y, tests)

    return F.filter(urls, lambda u: (domain(u) != "") & ~passes(domain(u)))


def risk(text: Column, allowed: Sequence[str] = ()) -> Column:
    found = {"pii": pii(text), "injection": injection(text), "profanity": profanity(text), "links": unallowed_links(text, allowed)}
    return F.least(F.lit(1.0), reduce(lambda x, y: x + y, [F.when(F.size(v) > 0, WEIGHTS[k]).otherwise(0.0) for k, v in found.items()]))


def sanitize(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[1], p[2]), PII, text)


def check(text: Column, allowed: Sequence[str] = ()) -> Column:
    """All checks as one struct."""
    return F.struct(pii(text).alias("pii"), profanity(text).alias("profanity"), injection(text).alias("injection"), unallowed_links(text, allowed).alias("unallowed_links"), risk(text, allowed).alias("risk"))
