"""Re-anchoring of quotes: the words of another text that a quote fits best, by edit distance.

Distances come from bit-parallel columns (64 cells of the table a machine word, many pairs side by side; long quotes as
one Python integer).  One pass of a quote over a text gives, for every position, the least distance of the quote to any
substring that ends there.  That bounds every window from below, so only windows whose bound is within the allowed distance
are measured themselves, the most promising first.  Before that, pairs are left out whose quote cannot be in the text: pieces
of the quote, measured side by side, are together no further from the text than the whole.  Nothing is lost, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

BLOCKS = 8                   # machine words per quote up to which pairs are measured side by side
STEP, ALONE = 30.0, 1.2      # microseconds of a step of all lanes for each machine word, and of one for one long quote or text alone
CELLS = 4 << 20              # positions of texts held at once
SLICE = 8 << 20              # bytes of quotes and texts taken at once
PIECE = 128                  # characters of a piece of a quote
CHUNK = 1024                 # characters of a text between two chunks a piece is measured in
LANES = 4096                 # lanes of a group


# --- distances ----------------------------------------------------------------------------------

def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """All characters numbered densely, the place of each text among them, and how many numbers there are."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    number[flat] = 1
    symbols = int(number.sum())
    codes = (np.cumsum(number) - 1)[flat]
    ends = np.cumsum([0, *map(len, texts)])
    return codes, ends, max(symbols, 1)


def _columns(masks: np.ndarray, symbols: int, of: np.ndarray, lengths: np.ndarray, blocks: int, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray,
             whole: bool, least: bool = False) -> np.ndarray:
    """Scores of lanes: quote ``of`` of ``masks`` against ``sizes`` characters of ``text`` from ``begin``.

    With ``whole`` one distance a lane.  Otherwise a row per position: the least distance to a substring that ends there; with
    ``least`` only the least of these.  Lanes are ordered by descending size.
    """
    lanes, most = len(of), int(sizes.max(initial=0))
    score = lengths.astype(np.int32)
    rows = np.zeros((0 if whole or least else most, lanes), np.int32)
    low = score.copy()
    pv = [np.full(lanes, ~np.uint64(0)) for _ in range(blocks)]
    mv = [np.zeros(lanes, np.uint64) for _ in range(blocks)]
    last, one, top = ((lengths - 1) % 64).astype(np.uint64), np.uint64(1), np.uint64(63)
    base = of * (blocks * symbols)
    for step in range(most):
        active = int(np.searchsorted(-sizes, -step, "left"))
        at = base[:active] + text[begin[:active] + step]
        plus = np.full(active, 1 if whole else 0, np.uint64)
        minus = np.zeros(active, np.uint64)
        for b in range(blocks):
            p, m = pv[b][:active], mv[b][:active]
            eq = masks[at + b * symbols]
            xv = eq | m
            eq |= minus
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            if b == blocks - 1:
                score[:active] += ((ph >> last[:active]) & one).astype(np.int32) - ((mh >> last[:active]) & one).astype(np.int32)
            up, down = ph >> top, mh >> top
            ph, mh = (ph << one) | plus, (mh << one) | minus
            pv[b][:active], mv[b][:active] = mh | ~(xv | ph), ph & xv
            plus, minus = up, down
        if least:
            np.minimum(low[:active], score[:active], out=low[:active])
        elif not whole:
            rows[step, :active] = score[:active]
    return low if least else score if whole else rows


def _long_columns(quote: str, text: str, whole: bool) -> list[int]:
    """The same for one pair with the quote as one integer: the score after every character."""
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    n, score, out = len(quote), len(quote), []
    full, top, first = (1 << n) - 1, 1 << (n - 1), int(whole)
    p, m = full, 0
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | m
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = m | (full & ~(xh | p)), p & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | first) & full, mh << 1 & full
        p, m = mh | (full & ~(xv | ph)), ph & xv
        out.append(score)
    return out


class Pairs:
    """Quotes and the texts they are looked for in; both are words joined by single spaces."""

    def __init__(self, quotes: list[str], texts: list[str]):
        self.quotes, self.texts = quotes, texts
        names: dict[str, int] = {}
        self.quote_of = np.array([names.setdefault(q, len(names)) for q in quotes], np.int64)
        distinct = list(names)
        holders: dict[str, int] = {}
        self.text_of = np.array([holders.setdefault(t, len(holders)) for t in texts], np.int64)
        codes, ends, self.symbols = _codes(distinct + list(holders))
        self.codes, self.quote_starts, text_ends = codes, ends[:len(distinct)], ends[len(distinct):]
        self.quote_sizes = np.diff(ends)[:len(distinct)]
        self.text_starts, self.text_sizes = text_ends[:-1], np.diff(text_ends)
        self.blocks = -(-self.quote_sizes // 64)

    def _masks(self, starts: np.ndarray, sizes: np.ndarray, blocks: int) -> np.ndarray:
        """For every quote (``sizes`` codes from ``starts``), block and symbol the bits where the symbol stands."""
        masks = np.zeros(len(starts) * blocks * self.symbols, np.uint64)
        quote = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = self.codes[np.repeat(starts, sizes) + place]
        np.bitwise_or.at(masks, (quote * blocks + place // 64) * self.symbols + code, np.uint64(1) << (place % 64).astype(np.uint64))
        return masks

    def lanes(self, pair: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, tuple | None]]:
        """Groups of lanes (pair, part of its text) with equal blocks, and the arguments of ``_columns`` for each.

        Long quotes, and texts so long that too few lanes would go on with them, come without arguments: they are measured alone.
        """
        blocks = self.blocks[self.quote_of[pair]]
        yield np.flatnonzero(blocks > BLOCKS), None
        for b in np.unique(blocks[blocks <= BLOCKS]).tolist():
            mine = np.flatnonzero(blocks == b)
            mine = mine[np.argsort(-sizes[mine], kind="stable")]
            cost = ALONE * np.concatenate([[0], np.cumsum(sizes[mine])]) + STEP * b * np.append(sizes[mine], 0)
            at = int(cost.argmin())
            yield mine[:at], None
            while at < len(mine):
                room = max(1, min(8192, CELLS // max(int(sizes[mine[at]]), 1), (CELLS << 2) // (b * self.symbols)))
                group = mine[at:at + room]
                distinct, of = np.unique(self.quote_of[pair[group]], return_inverse=True)
                yield group, (self._masks(self.quote_starts[distinct], self.quote_sizes[distinct], b), self.symbols, of, self.quote_sizes[distinct][of], b, self.codes, begin[group], sizes[group])
                at += room

    def _bound(self, pair: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per pair, for characters [low, high) of its quote: the sum of their pieces' least distances to any substring of the text.

        A text is measured in chunks; each goes on for twice the piece's length, beyond which no substring is nearer than none.
        """
        size = high - low
        pieces = -(-size // PIECE)
        own = np.repeat(np.arange(len(pair)), pieces)
        j = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = size[own] * j // pieces[own]
        length = size[own] * (j + 1) // pieces[own] - begin
        begin += self.quote_starts[self.quote_of[pair]][own] + low[own]
        text = self.text_of[pair][own]
        chunks = np.maximum(-(-self.text_sizes[text] // CHUNK), 1)
        piece = np.repeat(np.arange(len(own)), chunks)
        at = (np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        sizes = np.minimum(self.text_sizes[text][piece] - at, CHUNK + 2 * length[piece])
        at += self.text_starts[text][piece]
        least, blocks = length.copy(), -(-length // 64)[piece]
        for b in np.unique(blocks).tolist():
            mine = np.flatnonzero(blocks == b)
            mine = mine[np.argsort(-sizes[mine], kind="stable")]
            room = max(1, min(LANES, (CELLS << 2) // (b * self.symbols)))
            for group in np.split(mine, range(room, len(mine), room)):
                starts, first, of = np.unique(begin[piece[group]], return_index=True, return_inverse=True)
                lengths = length[piece[group]]
                found = _columns(self._masks(starts, lengths[first], b), self.symbols, of, lengths, b, self.codes, at[group], sizes[group], False, True)
                np.minimum.at(least, piece[group], found)
        return np.bincount(own, least, len(pair)).astype(np.int64)

    def hopeful(self, pair: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Those of ``pair`` whose text may hold the quote within ``most`` of it; none that does is left out."""
        n = self.quote_sizes[self.quote_of[pair]]
        middle = np.where(n > 64, -(-2 * n // 3), n)          # most pairs are out by the first two thirds
        bound = self._bound(pair, np.zeros_like(n), middle)
        left = np.flatnonzero(bound <= most[pair])
        bound = bound[left] + self._bound(pair[left], middle[left], n[left])
        return pair[left[bound <= most[pair[left]]]]

    def whole(self, pair: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Distance of each pair's quote to the characters [start, end) of its text."""
        out = np.zeros(len(pair), np.int64)
        for group, lanes in self.lanes(pair, self.text_starts[self.text_of[pair]] + start, end - start):
            if lanes:
                out[group] = _columns(*lanes, whole=True)
                continue
            for i in group.tolist():
                out[i] = _long_columns(self.quotes[pair[i]], self.texts[pair[i]][start[i]:end[i]], True)[-1]
        return out

    def best_windows(self, threshold: float) -> list[tuple[int, int] | None]:
        """Per pair (distance, number of the first word from 1) of the nearest window of as many words as the quote.

        None beyond ``threshold`` times the quote's characters.  Of equally near windows the first counts; a text of fewer
        words is one window.
        """
        n = self.quote_sizes[self.quote_of]
        most = np.floor(threshold * n + 1e-9).astype(np.int64)
        found: list[tuple[int, int] | None] = [None] * len(self.quotes)
        # a text much shorter than the quote cannot hold it
        pair = np.flatnonzero((n > 0) & (self.text_sizes[self.text_of] >= n - most) & (self.text_sizes[self.text_of] > 0))
        pair = self.hopeful(pair, most)
        windows: list[list[np.ndarray]] = []

        def collect(i: int, scores: np.ndarray) -> None:
            text, words = self.texts[i], self.quotes[i].count(" ") + 1
            gaps = np.flatnonzero(self.codes[self.text_starts[self.text_of[i]]:self.text_starts[self.text_of[i]] + len(text)] == space)
            starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(text))
            ends = ends[min(words, len(ends)) - 1:]
            near = np.flatnonzero(scores[ends - 1] <= most[i])
            if len(near):
                windows.append([np.full(len(near), i), near, starts[near], ends[near], scores[ends[near] - 1]])

        spaces = [t for t in self.texts if " " in t][:1]
        space = -1
        if spaces:
            i = self.texts.index(spaces[0])
            space = int(self.codes[self.text_starts[self.text_of[i]] + spaces[0].index(" ")])
        for group, lanes in self.lanes(pair, self.text_starts[self.text_of[pair]], self.text_sizes[self.text_of[pair]]):
            if not lanes:
                for i in pair[group].tolist():
                    scores = np.array(_long_columns(self.quotes[i], self.texts[i], False))
                    if scores.min() <= most[i]:
                        collect(i, scores)
                continue
            rows = _columns(*lanes, whole=False)
            hopeful = np.where(np.arange(len(rows))[:, None] < lanes[-1][None, :], rows, np.iinfo(np.int32).max).min(axis=0) <= most[pair[group]]
            for lane in np.flatnonzero(hopeful).tolist():
                collect(int(pair[group[lane]]), rows[:, lane])
        if not windows:
            return found
        who, word, start, end, bound = (np.concatenate(c) for c in zip(*windows))
        # the window with the least bound first, then those that could still be nearer, or as near and earlier
        order = np.lexsort((word, bound, who))
        first = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
        distance = np.full(len(who), -1, np.int64)
        distance[first] = self.whole(who[first], start[first], end[first])
        best = dict(zip(who[first].tolist(), zip(distance[first].tolist(), word[first].tolist())))
        limit = np.array([best[i] for i in who.tolist()])
        more = np.flatnonzero((distance < 0) & ((bound < limit[:, 0]) | ((bound == limit[:, 0]) & (word < limit[:, 1]))))
        for i, d, w in zip(who[more].tolist(), self.whole(who[more], start[more], end[more]).tolist(), word[more].tolist()):
            best[i] = min(best[i], (d, w))
        for i, (d, w) in best.items():
            if d <= most[i]:
                found[i] = (d, w + 1)
        return found


# --- the operator ---------------------------------------------------------------------------------

def folded(c: str) -> Column:
    """Words of a text, folded and joined by single spaces; a null text is empty."""
    return F.trim(F.regexp_replace(T.fold(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def anchor_quotes(pairs: DataFrame, quote: str, text: str, keys: list[str], threshold: float = 0.3, plain: bool = False) -> DataFrame:
    """(keys, distance, at, approximate): where each ``quote`` stands in the ``text`` beside it.

    Texts are compared folded, as words joined by single spaces.  ``at`` is the first word, from 1, of the window of as many
    words as the quote that is nearest by edit distance in characters; the first of equally near ones.  When none is within
    ``threshold`` times the quote's length, the quote is only anchored to the whole text: ``approximate``, and both numbers
    null.  Quotes without letters and digits give no row; a null text is empty.  With ``plain`` both are ``folded`` already:
    what stands in many pairs is folded before they are made.
    """
    def clean(c: str) -> Column:
        return F.col(c) if plain else folded(c)
    rows = pairs.select(F.struct(*keys).alias("_k"), clean(quote).alias("_q"), clean(text).alias("_t")).where("_q <> ''")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sizes = np.cumsum(np.diff(_offsets(b.column("_q"))) + np.diff(_offsets(b.column("_t"))))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
                part = b.slice(at, stop - at)
                found = Pairs(part.column("_q").to_pylist(), part.column("_t").to_pylist()).best_windows(threshold)
                yield pa.RecordBatch.from_arrays([part.column("_k"), pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.int64()),
                                                  pa.array([f is None for f in found])], ["_k", "distance", "at", "approximate"])
                at = stop
    kind = rows.schema["_k"].dataType.simpleString()
    return rows.mapInArrow(run, f"_k {kind}, distance bigint, at bigint, approximate boolean").select("_k.*", "distance", "at", "approximate")


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
