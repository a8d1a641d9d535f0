"""Text normalisation, folding, tokenising and stemming.

Everything on the hot path is a JVM expression.  Python runs only for Unicode
normal forms and the stemmer, and there as Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """All runs of letters and digits, in order."""
    return F.regexp_extract_all(_col(text), F.lit(f"({TOKEN})"), 1)


# --- folding ---------------------------------------------------------------------------

# Fixed value: Hebrew accents, vowel points and marks.
HEBREW_POINTS = "\u0591-\u05c7"
# Fixed value: cantillation only; vowels, dagesh and the shin/sin dots are kept.
HEBREW_ACCENTS = "\u0591-\u05af\u05bd\u05bf\u05c0\u05c3-\u05c6"
COMBINING = "\u0300-\u036f"


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Every precomposed BMP letter whose decomposition minus combining marks is one letter."""
    source, target = [], []
    for cp in range(0xC0, 0x10000):
        ch = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if parts == ch:
            continue
        base = re.sub(f"[{COMBINING}]", "", parts)
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def strip_marks(text: Column | str) -> Column:
    """Canonical decomposition minus U+0300..U+036F, without leaving the JVM."""
    source, target = _base_letters()
    return F.translate(F.regexp_replace(_col(text), f"[{COMBINING}]", ""), source, target)


def fold(text: Column | str) -> Column:
    """Case- and accent-insensitive form for search; both sides of a match use it."""
    return F.lower(strip_marks(text))


def search_form(text: Column | str) -> Column:
    """Index form of an original-language word: points and separators removed, then folded."""
    bare = F.regexp_replace(_col(text), f"[{HEBREW_POINTS}/]", "")
    return fold(F.trim(bare))


def consonantal(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), f"[{HEBREW_POINTS}/]", ""))


def accent_fold(text: Column | str, language: Column | str) -> Column:
    """Remove cantillation but keep vowels; scripts other than Hebrew/Aramaic are untouched."""
    t = _col(text)
    return F.when(_col(language).isin("hbo", "arc"),
                  F.regexp_replace(t, f"[{HEBREW_ACCENTS}]", "")).otherwise(t)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def nfd_fold(text: pd.Series) -> pd.Series:
    """The general form of ``fold`` for any script; used to check it."""
    drop = re.compile(f"[{COMBINING}]")
    return text.map(lambda s: None if s is None else drop.sub("", unicodedata.normalize("NFD", s)).lower())


# --- normalisation ------------------------------------------------------------------------

# Words known to be welded in one distribution, with their repair.
WELDED_WORDS = {
    "windblows": "wind blows",
    "generationwill": "generation will",
    "whenmen": "when men",
    "disregardhis": "disregard his",
    "drachmacoins": "drachma coins",
    "thingsbecause": "things because",
    "yourwoman": "your woman",
}
# Residue and weld patterns.
NOTE_RESIDUE = r"(?s)/f\s*\+.*?/f\*"
WELDED_PUNCTUATION = r"([a-z])([.,;:!?])([A-Za-z])"


def collapse(text: Column | str) -> Column:
    """Whitespace runs to one space, ends trimmed (Unicode white space)."""
    return F.trim(F.regexp_replace(_col(text), "(?U)[\\s\ufeff]+", " "))


def normalize_unit(text: Column | str, welds: dict[str, str] | None = None, compose: bool = True) -> Column:
    """Composed, residue removed, listed welds repaired, welded punctuation spaced, collapsed."""
    out = nfc(_col(text)) if compose else _col(text)
    out = F.regexp_replace(out, NOTE_RESIDUE, "")
    for joined, spaced in (WELDED_WORDS if welds is None else welds).items():
        out = F.regexp_replace(out, rf"\b{joined}\b", spaced)
    return collapse(F.regexp_replace(out, WELDED_PUNCTUATION, "$1$2 $3"))


# Named entities the sources use.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _numeric_entities(text: Column) -> Column:
    """``&#8220;`` and ``&#x201D;`` by code point, inside the JVM; texts without any are passed through."""
    pattern = r"&#(x[0-9a-fA-F]+|[0-9]+);"

    def character(code: Column) -> Column:
        digits = F.when(F.startswith(code, F.lit("x")), F.regexp_replace(code, "^x", "")).otherwise(F.hex(F.regexp_replace(code, "^x.*", "0").cast("bigint")))
        return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    chars = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), character)
    pieces = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)


def decode_entities(text: Column | str, numeric: bool = True) -> Column:
    """Named entities in one pass order (``&amp;`` last), numeric ones by code point.

    ``&amp;`` is resolved through a private mark so that ``&amp;lt;`` becomes ``&lt;`` and not ``<``.
    """
    out = F.replace(_col(text), F.lit("&amp;"), F.lit("\ue000"))
    for name, value in ENTITIES.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    out = F.replace(out, F.lit("\ue000"), F.lit("&"))
    return _numeric_entities(out) if numeric else out


def strip_markup(text: Column | str, numeric: bool = True) -> Column:
    """Tags removed without substitution, entities decoded, pilcrow to space."""
    return F.replace(decode_entities(F.regexp_replace(_col(text), r"<[^>]*>", ""), numeric), F.lit("¶"), F.lit(" "))


def first_sentence(text: Column | str, limit: int = 180) -> Column:
    """Up to the first terminator (with closing quotes) followed by space; clipped at a word."""
    trimmed = F.trim(_col(text))
    found = F.regexp_extract(trimmed, r"(?s)^(.*?[.!?][\"'”’)]*)(?=\s)", 1)
    sentence = F.when(F.length(found) > 0, found).otherwise(trimmed)
    clipped = F.substring(sentence, 1, limit)
    at_word = F.regexp_extract(clipped, r"(?s)^(.+) [^ ]*$", 1)
    cut = F.when(F.length(at_word) > 0, at_word).otherwise(clipped)
    return F.when(F.length(sentence) <= limit, sentence).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def spoken_english(text: Column | str) -> Column:
    """What a reader says, as letters, apostrophes and single spaces."""
    lowered = F.replace(F.lower(strip_marks(text)), F.lit("’"), F.lit("'"))
    return F.regexp_replace(lowered, "[^a-z' ]+", " ")


# What is said for two names that are never read as written.
SPOKEN_FOR_KEY = {"H3068": "adonay", "H3069": "elohim"}


def spoken_key(surface: Column | str, key: Column | str) -> Column:
    """The spoken substitute by dictionary key, with any prefix morphemes kept before it."""
    base = F.regexp_replace(_col(key), "[a-g]+$", "")
    spoken = F.lit(None).cast("string")
    for k, said in SPOKEN_FOR_KEY.items():
        spoken = F.when(base == k, F.lit(said)).otherwise(spoken)
    prefix = F.regexp_replace(F.regexp_replace(_col(surface), "/?[^/]*$", ""), "/", "")
    return F.when(spoken.isNotNull(), F.concat(prefix, spoken)).otherwise(F.regexp_replace(_col(surface), "/", ""))


def matches_all(query: Column | str, *fields: Column | str) -> Column:
    """True when every white-space separated token of the query occurs in the folded fields."""
    hay = fold(F.concat_ws(" ", *[_col(f) for f in fields]))
    parts = F.filter(F.split(fold(query), r"\s+"), lambda t: F.length(t) > 0)
    return F.forall(parts, lambda t: F.contains(hay, t))


# --- stemming (Porter, 1980) ------------------------------------------------------------------

_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    return True if c != "y" else (i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


# The suffix rules of the published algorithm (steps 2, 3 and 4).
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, repl in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                stem = w[: len(w) - len(suffix)]
                if _measure(stem) > 0:
                    w = stem + repl
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(word: pd.Series) -> pd.Series:
    return word.map(lambda s: None if s is None else porter(s))
