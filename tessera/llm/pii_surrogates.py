"""Surrogates for personal data and secrets.

Entities are detected in whole texts: e-mail addresses, telephone numbers (international, and national forms that
begin with 0 or an area code), payment cards, IPv4 and IPv6 addresses, IBANs, US social security numbers, access
keys, quoted or assigned secrets, and persons named after an honorific or a phrase that introduces a name. Each
is replaced by a keyed surrogate of its type and format: a permutation, drawn from the key, of all strings of
the entity's shape (digits stay digits, letters keep case and script, hexadecimal stays hexadecimal, punctuation
and grouping stay), so different entities of one shape never share a surrogate and one entity always gets the same
(coreference holds across documents and spellings: numbers are compared by their digits, addresses and names
without case). Cards keep their first digit and whether the check digit fits, IP addresses stay private or
public, IBANs get fitting check digits.

Persons are replaced by name parts: a family name has one surrogate wherever and after whatever honorific it
stands, a given name one for each gender (of the honorific, else of the lists below, else unknown; a name of unknown
gender takes that which the corpus shows elsewhere). Once a text introduces a name, its later bare mentions,
whole or in part, are replaced, too. Names without any introduction are not detected.

A collision check over all distinct entities then finds surrogates that are another's (names are drawn
from lists and syllables, and may be) or that are themselves real entities of the corpus; those entities get
another permutation, and after WIDEN_AFTER vain ones a longer shape, until none is left. If some are left after
all rounds, that is an error; nothing is left in clear or made alike in silence.

Null texts stay null, texts without entities (empty ones among them) stay as they are, repeated rows get equal
results, all other columns are kept, also those named as the report's (whose names then begin with ``pii_``), and an
empty table gives an empty table. Very long texts are one row of a batch and take time in proportion.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize

EMAIL = re.compile(r"(?<![\w.%+\-])[\w%+\-][\w.%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
NUMBER = re.compile(r"\d[\d\- ()./]{4,}")  # widened to the left by + and (, then taken apart by NUMBER_FORMS
NUMBER_FORMS = tuple(
    (kind, re.compile(p))
    for kind, p in (
        ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
        ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
        ("card", r"(?<![\d])[3-6]\d{3}([ \-]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?(?!\d)"),
        ("phone", r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"),
        ("phone", r"(?<![\d+])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\- ]\d{4}(?!\d)"),
        ("phone", r"(?<![\d+.\-/])(?:0\d{2,4}[ /\-]\d{3,4}(?:[ \-]?\d{3,5})|0\d(?:[ .]\d\d){4})(?![\d.\-/])"),
    )
)
SSN_NAME = re.compile(r"(?:SSN|social security(?: number| no\.?)?)\W{0,4}(?:is |=|:)?\s{0,2}(?P<value>\d{9})(?!\d)", re.IGNORECASE)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IBAN_HEAD = re.compile(r"\d\d ?[A-Z0-9]{4} ?[A-Z0-9]{4}")
ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|sk_live_|xox[bp]-)[A-Za-z0-9_\-]{16,}")
ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']?(?P<value>[^\s\"'<>,;]{8,})")
ASSIGNED_NAME = re.compile(r"(?:pass(?:word|wd|phrase)?|secret|token|api[_\- ]?key|access[_\- ]?key|auth)[\"']?\s{0,3}$", re.IGNORECASE)

#: Honorifics by gender, and given and family names by script and gender. Fixed values.
HONORIFICS = {
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "x": ("Dr", "Prof", "Mx"),
}
#: A text without any of these holds no honorific.
HONORIFIC_STEMS = ("Mr ", "Mr.", "Mrs", "Ms ", "Ms.", "Miss ", "Mister ", "Herr", "Frau ", "Monsieur ", "Madame ", "Mme", "Señor", "Sr ", "Sr.", "Sra", "Dr ", "Dr.", "Prof", "Mx", "Госпо", "Κύριος ", "Κυρία ")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Elena", "Fiona", "Greta", "Helen", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Леонид"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лидия"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
}
SYLLABLES = {"latin": ("ba", "den", "fel", "gor", "hal", "ker", "lin", "mar", "nov", "ros", "sel", "tor", "vald", "wen", "zan", "mont"), "cyrillic": ("бар", "вол", "гор", "дем", "кар", "лов", "мир", "нов", "пет", "рос", "сол", "том", "фед", "хар", "чер", "шил"), "greek": ("βαλ", "γερ", "δημ", "ζαν", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σταμ", "τσιλ", "φωτ", "χατζ", "ψαρ")}
GIVEN_END = {"latin": {"m": "us", "f": "ina"}, "cyrillic": {"m": "слав", "f": "ина"}, "greek": {"m": "ος", "f": "ία"}}
FAMILY_END = {"latin": "er", "cyrillic": "ко", "greek": "ίδη"}
NAME = r"[^\W\d_][\w'\-]*"
PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(sum(HONORIFICS.values(), ()), key=len, reverse=True)) + rf")\.? ({NAME}(?: {NAME})?)")
#: Phrases that introduce a given and a family name. Fixed values.
INTRODUCTIONS = ("my name is", "name:", "Name:", "ich heiße", "mein Name ist", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "signed by", "on behalf of")
INTRODUCED = re.compile(r"(?<!\w)(?:" + "|".join(INTRODUCTIONS) + rf") ({NAME}) ({NAME})", re.IGNORECASE)
NAME_WORD = re.compile(NAME)
_LISTED = {name.casefold(): gender for (_, gender), names in GIVEN.items() for name in names}


def names_in(text: str) -> dict[str, str]:
    """Kinds ("family", "given-m", "given-f", "given-x") of the names that the text introduces, by spelling."""
    kinds: dict[str, str] = {}
    spelled: list[str] = []
    single: list[str] = []

    def person(given: str, family: str, gender: str) -> None:
        g = gender if gender != "x" else _LISTED.get(given.casefold(), "x")
        if kinds.get(given.casefold(), "given-x") == "given-x":
            kinds[given.casefold()] = f"given-{g}"
        kinds.setdefault(family.casefold(), "family")
        spelled.extend((given, family))

    for m in PERSON.finditer(text) if any(h in text for h in HONORIFIC_STEMS) else ():
        names = m.group(2).split(" ")
        if names[0][0].isupper():
            gender = next(g for g, h in HONORIFICS.items() if m.group(1) in h)
            if len(names) > 1 and names[1][0].isupper():
                person(names[0], names[1], gender)
            else:
                single.append(names[0])
    lowered = text.casefold()
    for m in INTRODUCED.finditer(text) if any(x.casefold() in lowered for x in INTRODUCTIONS) else ():
        if m.group(1)[0].isupper() and m.group(2)[0].isupper():
            person(m.group(1), m.group(2), "x")
    for name in single:
        kinds.setdefault(name.casefold(), "family")
        spelled.append(name)
    out = {}
    for name in spelled:
        name = name.removesuffix("'s")
        for form in (name, name.upper()):
            if kind := kinds.get(name.casefold()) or kinds.get(f"{name}'s".casefold()):
                out[form] = kind
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of the text as (start, end, kind, canonical form), without overlaps, in order."""
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(start: int, end: int, kind: str, canonical: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            out.append((start, end, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m.group().lower())
    if "=" in text or ":" in text:
        for m in ASSIGNED.finditer(text):
            if ASSIGNED_NAME.search(text, max(0, m.start() - 24), m.start()):
                add(m.start("value"), m.end("value"), "secret", m.group("value"))
        for m in IPV6.finditer(text) if "::" in text or text.count(":") > 6 else ():
            if sum(map(bool, m.group().split(":"))) > 2 and (whole := _ipv6(m.group())):
                add(m.start(), m.end(), "ipv6", whole)
    if any(x in text for x in ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xox")):
        for m in ACCESS.finditer(text):
            add(m.start(), m.end(), "secret", m.group())
    for m in SSN_NAME.finditer(text):
        add(m.start("value"), m.end("value"), "ssn", m.group("value"))
    for wide in NUMBER.finditer(text):
        begin = wide.start()
        while begin and text[begin - 1] in "+(":
            begin -= 1
        for kind, form in NUMBER_FORMS:
            for m in form.finditer(text, begin, wide.end()):
                canonical = m.group() if kind == "ip" else "".join(c for c in m.group() if c.isdigit())
                if kind != "phone" or len(canonical) >= 7:
                    add(m.start(), m.end(), kind, canonical)
    for head in IBAN_HEAD.finditer(text):
        if m := IBAN.match(text, head.start() - 2) if head.start() > 1 else None:
            add(m.start(), m.end(), "iban", m.group().replace(" ", ""))
    if known := names_in(text):
        for m in NAME_WORD.finditer(text):
            word = m.group() if m.group() in known else m.group().removesuffix("'s")
            if word in known:
                add(m.start(), m.start() + len(word), known[word], word.casefold())
    return sorted(out)


def _ipv6(value: str) -> str | None:
    try:
        return ipaddress.IPv6Address(value).exploded
    except ValueError:
        return None


@functools.lru_cache(maxsize=20_000)
def _letters(c: str) -> str:
    """The letters that ``c`` may become: for scripts without a list those of its kind among its 64 neighbours in Unicode."""
    for row in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "éèêàáäöüßñçíóú", "ÉÈÊÀÁÄÖÜÑÇÍÓÚ"):
        if c in row:
            return row
    kind, first = unicodedata.category(c), ord(c) & ~63
    if kind[0] not in "LN":
        return c
    return "".join(chr(x) for x in range(first, first + 64) if unicodedata.category(chr(x)) == kind)


def _classes(value: str, kind: str) -> list[str]:
    """For each character the letters it may become; a single letter is kept as it is."""
    if kind == "secret" and re.fullmatch(r"(?:AKIA|ASIA)[A-Z0-9]{16}", value):
        return [*value[:4], *["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(value) - 4)]
    if kind == "secret" and len(value) >= 12 and re.fullmatch(r"[0-9a-f]+", value):
        return ["0123456789abcdef"] * len(value)
    return [_letters(c) for c in value]


def permute(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """A keyed permutation of the strings that ``alphabets`` allow: Feistel rounds on the string's rank, walked until inside."""
    total, rank = 1, 0
    for c, letters in zip(value, alphabets, strict=True):
        total *= len(letters)
        rank = rank * len(letters) + letters.index(c)
    if total == 1:
        return value
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = rank >> half, rank & mask
        for i in range(6):
            seed = f"{tweak}|{total}|{i}|{right}".encode()
            digest = hmac.new(key, seed, hashlib.sha256).digest()
            while len(digest) < size:
                digest += hmac.new(key, digest + seed, hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(digest[:size], "big") & mask)
        rank = (left << half) | right
        if rank < total:
            break
    out = []
    for letters in reversed(alphabets):
        rank, at = divmod(rank, len(letters))
        out.append(letters[at])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that fits ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _ip_class(value: str) -> str:
    a, b, *_ = map(int, value.split("."))
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return f"private {a}"
    return "loopback" if a == 127 else "special" if a == 0 or a >= 224 or (a, b) == (169, 254) else "public"


def _script(text: str) -> str:
    for c in text:
        name = unicodedata.name(c, "")
        if name.startswith("CYRILLIC"):
            return "cyrillic"
        if name.startswith("GREEK"):
            return "greek"
    return "latin"


#: Attempts in one shape; after each such number a shape gets one character more.
WIDEN_AFTER = 12


def _wider(value: str, attempt: int) -> str:
    """``value`` with as many more characters as its shape was tried in vain; their kind is the last letter's or digit's."""
    last = next((c for c in reversed(value) if len(_letters(c)) > 1), "a")
    return value + _letters(last)[0] * (attempt // WIDEN_AFTER)


def _hexadecimal(whole: str, key: bytes, tweak: str) -> str:
    """An exploded IPv6 address whose groups keep their number of digits; special prefixes stay."""
    groups = [g.lstrip("0") for g in whole.split(":")]
    fixed = 2 if whole.startswith("2001:0db8") else 1 if whole.startswith(("fe8", "fc", "fd", "ff", "0000")) else 0
    value = "".join(groups[fixed:])
    letters = [x for g in groups[fixed:] for x in ("123456789abcdef", *["0123456789abcdef"] * (len(g) - 1))[: len(g)]]
    made = iter(permute(value, letters, key, tweak + str([*map(len, groups)])))
    new = [*groups[:fixed], *("".join(next(made) for _ in g) for g in groups[fixed:])]
    return ":".join(g.rjust(4, "0") for g in new)


@functools.lru_cache(maxsize=100_000)
def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity. Pure; ``attempt`` selects another permutation."""
    tweak = f"{kind}|{attempt}"
    digits = "0123456789"
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] == "example" else 1
        local = _wider(local, attempt)
        host = [permute(x, _classes(x, kind), key, f"{tweak}|label") for x in labels[:-keep]]
        return permute(local, _classes(local, kind), key, tweak) + "@" + ".".join([*host, *labels[-keep:]])
    if kind == "card":
        offset = (int(canonical[-1]) - luhn(canonical[:-1])) % 10
        body = permute(canonical[:-1], [canonical[0], *[digits] * (len(canonical) - 2)], key, tweak)
        return body + str((luhn(body) + offset) % 10)
    if kind == "phone":
        country = 1 if canonical[0] in "01" and len(canonical) > 9 else 0
        alphabets = [*canonical[:country], *[digits] * (len(canonical) - country)]
        return permute(canonical, alphabets, key, tweak)
    if kind == "ip":
        rank, group = canonical, _ip_class(canonical)
        while True:
            number = int.from_bytes(bytes(map(int, rank.split("."))), "big")
            number = int(permute(f"{number:032b}", ["01"] * 32, key, tweak), 2)
            rank = ".".join(map(str, number.to_bytes(4, "big")))
            if _ip_class(rank) == group:
                return rank
    if kind == "ipv6":
        return _hexadecimal(canonical, key, tweak)
    if kind == "iban":
        body = permute(canonical[4:], _classes(canonical[4:], kind), key, tweak + canonical[:2])
        number = "".join(str(int(c, 36)) for c in f"{body}{canonical[:2]}00")
        return f"{canonical[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "family" or kind.startswith("given"):
        return _person(kind, canonical, int.from_bytes(hmac.new(key, f"{tweak}|{canonical}".encode(), hashlib.sha256).digest(), "big"), attempt)
    canonical = _wider(canonical, attempt)
    alphabets, shape = _classes(canonical, kind), None
    while True:  # until the shape that chose the alphabets is the same, which keeps this a permutation
        shape = permute(shape or canonical, alphabets, key, tweak)
        if _classes(shape, kind) == alphabets:
            return shape


def _person(kind: str, canonical: str, draw: int, attempt: int) -> str:
    """A name of the script: given names from the lists first, then, like family names, of syllables, one more each attempt."""
    script, gender = _script(canonical), kind[-1]
    if kind != "family" and attempt == 0:
        names = GIVEN[script, gender] if gender in "mf" else GIVEN[script, "m"] + GIVEN[script, "f"]
        return next(n for i in (0, 1) if (n := names[(draw + i) % len(names)]).casefold() != canonical)
    name = ""
    for _ in range(2 + attempt):
        draw, at = divmod(draw, 16)
        name += SYLLABLES[script][at]
    return (name + (FAMILY_END[script] if kind == "family" else GIVEN_END[script].get(gender, ""))).capitalize()


def dress(original: str, kind: str, found: str) -> str:
    """The canonical surrogate in the original's case and grouping."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(found)
        return "".join(next(rest, "") if c.isalnum() else c for c in original)
    if kind == "ipv6":
        groups = original.split(":")
        whole, at = found.split(":"), groups.index("") if "" in groups else 8
        tail = len(groups) - at - 1 if at < 8 else 0
        places = [*range(min(at, 8)), *[None] * (at < 8), *range(8 - tail, 8)]
        made = ":".join("" if g == "" else f"{int(whole[i], 16):x}".rjust(len(g), "0") for g, i in zip(groups, places, strict=True))
        return made.upper() if original.upper() == original else made
    if kind == "email":
        rest = iter(found)
        return "".join(c.upper() if o.isupper() else c for o, c in zip(original, rest, strict=True)) if len(original) == len(found) else found
    if kind == "family" or kind.startswith("given"):
        return found.upper() if len(original) > 1 and original.isupper() else found
    return found


Moved = dict[tuple[str, str], tuple[str, int]]  # (kind, canonical): the kind it is replaced as, and the attempt


def rewrite(text: str, key: bytes, moved: Moved) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced, in order."""
    last, out, kinds = 0, [], []
    for start, end, kind, canonical in find(text):
        as_kind, attempt = moved.get((kind, canonical), (kind, 0))
        out += [text[last:start], dress(text[start:end], kind, surrogate(as_kind, canonical, key, attempt))]
        last = end
        kinds.append(kind)
    return ("".join([*out, text[last:]]) if out else text), kinds


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canonical) of the corpus. Duplicates of a batch go before the shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({e[2:] for t in batch.column(0).to_pylist() if t for e in find(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([c for _, c in got], pa.string())], names=["kind", "canonical"])

    return docs.select("text").mapInArrow(run, "kind string, canonical string").distinct()


def attempts_for(docs: DataFrame, key: bytes, most: int = 80) -> DataFrame | None:
    """Entities that are replaced as another kind or with another attempt than 0, as (kind, canonical, as_kind, attempt); None if there are none."""
    known = materialize(entities(docs), "entities")

    @F.pandas_udf("string")
    def replaced(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, key, int(a)) for k, c, a in zip(kind, canonical, attempt, strict=True)])

    # a given name of unknown gender that has one elsewhere
    gendered = known.where("kind in ('given-m', 'given-f')").groupBy("canonical").agg(F.min("kind").alias("as_kind"))
    alike = materialize(known.where("kind = 'given-x'").join(gendered, "canonical").select("kind", "canonical", "as_kind"), "alike")
    space = F.substring_index("kind", "-", 1).alias("space")  # kinds whose surrogates must differ
    state = known.join(alike, ["kind", "canonical"], "left_anti").withColumn("attempt", F.lit(0))
    real = known.select(space, F.lower("canonical").alias("made")).distinct().withColumn("real", F.lit(True))
    for _ in range(most):
        made = materialize(state.withColumns({"made": F.lower(replaced("kind", "canonical", "attempt")), "space": space}), "surrogates")
        # of those that share a surrogate the smallest entity keeps it; an aggregate, so a popular one needs no single task
        keeper = made.groupBy("space", "made").agg(F.min(F.struct("canonical", "kind")).alias("keeper"))
        judged = made.join(keeper, ["space", "made"]).join(real, ["space", "made"], "left")
        bad = (F.struct("canonical", "kind") != F.col("keeper")) | F.col("real").isNotNull()
        state = materialize(judged.select("kind", "canonical", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad")), "attempts")
        if state.where("bad").isEmpty():
            break
        state = state.drop("bad")
    else:
        left = ", ".join(f"{r['count']} of kind {r['kind']}" for r in state.where(F.col("attempt") == most).groupBy("kind").count().collect())  # one row a kind
        raise ValueError(f"after {most} rounds entities still have surrogates that are another's or real: {left}")
    state = state.select("kind", "canonical", "attempt")
    moved = state.where("attempt > 0").select("kind", "canonical", F.col("kind").alias("as_kind"), "attempt")
    taken = alike.join(state.select(F.col("kind").alias("as_kind"), "canonical", "attempt"), ["as_kind", "canonical"]).select("kind", "canonical", "as_kind", "attempt")
    moved = moved.unionByName(taken)
    return None if moved.isEmpty() else moved


_MOVED = "array<struct<kind:string,canonical:string,as_kind:string,attempt:int>>"


def replace_pii(docs: DataFrame, key: bytes, report: bool = True) -> DataFrame:
    """``docs`` with ``text`` rewritten; ``report`` adds ``n_entities`` and ``kinds``.

    ``key`` must be secret: who has it can undo most surrogates. The texts are read twice and never shuffled,
    unless some entity needs another attempt: then each row is joined with the attempts of its own entities.
    """
    bounded_batches(docs.sparkSession)
    moved = attempts_for(docs, key)
    columns = docs.columns
    if moved is not None:

        @F.pandas_udf("array<struct<kind:string,canonical:string>>")
        def named(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"kind": e[2], "canonical": e[3]} for e in find(t)] if t else [] for t in texts])

        keyed = docs.withColumn("__row", F.md5("text"))
        own = keyed.select("__row", F.explode(named("text")).alias("e")).select("__row", "e.*").distinct()
        own = own.join(moved, ["kind", "canonical"]).groupBy("__row").agg(F.collect_set(F.struct("kind", "canonical", "as_kind", "attempt")).alias("__moved"))
        docs = _with_moved(keyed, materialize(own, "moved")).drop("__row")
    else:
        docs = docs.withColumn("__moved", F.lit(None).cast(_MOVED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, kinds = [], []
            for text, moved_of in zip(table["text"].to_pylist(), table.pop("__moved").to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    kinds.append([])
                    continue
                new, found = rewrite(text, key, {(m["kind"], m["canonical"]): (m["as_kind"], m["attempt"]) for m in moved_of or ()})
                texts.append(new)
                kinds.append(found)
            table["text"] = pa.array(texts, pa.string())
            if report:
                table |= {counted: pa.array(list(map(len, kinds)), pa.int64()), listed: pa.array(kinds, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(table.values()), names=list(table))

    counted, listed = (f"pii_{n}" if n in columns else n for n in ("n_entities", "kinds"))
    fields = [f for f in docs.schema.fields if f.name in columns]
    if report:
        fields += [T.StructField(counted, T.LongType()), T.StructField(listed, T.ArrayType(T.StringType()))]
    return docs.select(*[f"`{c}`" for c in columns], "__moved").mapInArrow(run, T.StructType(fields))


#: Rows of moved entities (of documents that hold one, about 100 bytes each) that may be broadcast to the scan.
BROADCAST_MOVED = 200_000


def _with_moved(keyed: DataFrame, own: DataFrame) -> DataFrame:
    few = own.limit(BROADCAST_MOVED + 1).count() <= BROADCAST_MOVED
    return keyed.join(F.broadcast(own) if few else own, "__row", "left")


def configured_key(spark: SparkSession) -> bytes:
    """The key in the setting ``spark.tessera.pii.key``, or, where none is set, a random one that nobody keeps."""
    found = spark.conf.get("spark.tessera.pii.key", None)
    return found.encode() if found else secrets.token_bytes(32)
