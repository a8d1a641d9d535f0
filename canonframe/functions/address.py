"""The packed address ``book * 1_000_000 + chapter * 1_000 + unit``.

The space is sparse, so the difference of two addresses is never a distance.
Operators that need distance work on the position of an address in the sorted
space (see ``operators.space``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the address format.
BOOK_FACTOR = 1_000_000
CHAPTER_FACTOR = 1_000
MAX_PART = 999

# Vote floors of the link tiers.
STRONG_VOTES = 20
MODERATE_VOTES = 5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(value: Column | str, by: int | Column) -> Column:
    """Integer division that keeps BIGINT (``/`` would go through DOUBLE)."""
    v = _col(value).cast("bigint")
    d = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.floor((v - F.pmod(v, d)) / d).cast("bigint")


def pack(book, chapter, unit) -> Column:
    return (_col(book).cast("bigint") * BOOK_FACTOR
            + _col(chapter).cast("bigint") * CHAPTER_FACTOR + _col(unit).cast("bigint"))


def parts_valid(book, chapter, unit) -> Column:
    """True when the three parts fit the encoding."""
    return ((_col(book) >= 1) & _col(chapter).between(1, MAX_PART) & _col(unit).between(1, MAX_PART))


def pack_checked(book, chapter, unit) -> Column:
    """The address, or NULL when a part does not fit."""
    return F.when(parts_valid(book, chapter, unit), pack(book, chapter, unit))


def book_of(addr) -> Column:
    return F.expr(f"{addr} div {BOOK_FACTOR}") if isinstance(addr, str) else int_div(addr, BOOK_FACTOR)


def chapter_of(addr) -> Column:
    if isinstance(addr, str):
        return F.expr(f"({addr} div {CHAPTER_FACTOR}) % {CHAPTER_FACTOR}")
    return int_div(addr, CHAPTER_FACTOR) % CHAPTER_FACTOR


def unit_of(addr) -> Column:
    return _col(addr) % CHAPTER_FACTOR


def chapter_key(addr: str) -> Column:
    """Address of the chapter's (unit 0) start: equal for all units of a chapter."""
    return F.expr(f"({addr} div {CHAPTER_FACTOR}) * {CHAPTER_FACTOR}")


def is_encodable(addr) -> Column:
    a = _col(addr)
    return ((a >= BOOK_FACTOR)
            & (int_div(a, CHAPTER_FACTOR) % CHAPTER_FACTOR).between(1, MAX_PART)
            & (a % CHAPTER_FACTOR).between(1, MAX_PART))


def chapter_start(book, chapter) -> Column:
    return pack(book, chapter, F.lit(1))


def chapter_end(book, chapter) -> Column:
    return pack(book, chapter, F.lit(MAX_PART))


def book_start(book, has_prologue=None) -> Column:
    first = pack(book, F.lit(1), F.lit(1))
    if has_prologue is None:
        return first
    return F.when(_col(has_prologue), prologue(book)).otherwise(first)


def book_end(book) -> Column:
    return pack(book, F.lit(MAX_PART), F.lit(MAX_PART))


def prologue(book) -> Column:
    """Chapter 1, unit 0: the slot of a collection's unnumbered opening."""
    return pack(book, F.lit(1), F.lit(0))


def chapter_span(start, end) -> Column:
    """Chapters touched, NULL when the range crosses collections."""
    s, e = _col(start), _col(end)
    same = int_div(s, BOOK_FACTOR) == int_div(e, BOOK_FACTOR)
    return F.when(same, int_div(e, CHAPTER_FACTOR) - int_div(s, CHAPTER_FACTOR) + 1)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Inclusive at both ends."""
    return (_col(a_start) <= _col(b_end)) & (_col(a_end) >= _col(b_start))


def vote_tier(votes) -> Column:
    v = _col(votes)
    return (F.when(v >= STRONG_VOTES, "strong").when(v >= MODERATE_VOTES, "moderate")
            .otherwise("light"))
