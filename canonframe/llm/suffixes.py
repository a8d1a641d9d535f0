"""Operator 12, removal of repeated byte strings through suffix arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else, in another document or in the same
one.  Strings never cross documents and are judged on the input.

All strings of ``length`` bytes would be as many rows as bytes.  Instead every string is named by the least hash of its
``GRAM``-byte grams (its *key*), which is the same wherever the string stands; neighbouring strings mostly share a key, so a
text falls into *segments*, runs of starts with one key (about one per 170 bytes).

1. Segments are counted by (key, hash of their bytes).  A segment that occurs twice repeats wholly; a segment that occurs once
   and alone has the key repeats nowhere, unless the key stands in it several times.  Only the other keys, those with several
   different segments for the most part, need their bytes, one copy of each segment.
2. These segments are dealt to shards by key, so equal strings always meet.  A shard has a suffix array (Larsson-Sadakane:
   ranks by eight bytes, then only unsorted groups are refined by doubled depth) and the common prefixes of neighbours
   (Kasai, all segments of the shard side by side).  Strings with a neighbour in common for ``length`` bytes repeat.  What is
   dealt together but exceeds ``SHARD_BYTES`` is cut into several shards, which are merged by binary search of the strings of
   one in the suffix array of the other.
3. A key whose different segments exceed ``HOT_BYTES`` (a phrase that a share of all documents holds) is not put in one
   shard: its strings are dealt again by the bytes that runs of ``BLOCK`` starts have in common, and those still sharing by
   their own hash.  Both are counts, folded before the shuffle, and exact.

Tables are joined on hashes of 64 + 64 bits.  Facts about keys so frequent that they would fill one task are at most
``1 / SHARE`` many and are broadcast; all others are joined by shuffle.

* null texts are empty; texts shorter than ``length`` bytes keep everything; null, repeated ids and equal rows are rows like
  any other (equal rows repeat each other); an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, mix64, slices, texts

GRAM = 64                    # bytes hashed together, a power of two
RUN = 4096                   # most starts of one segment
BUFFER = 2 << 20             # bytes hashed at once
SHARD_BYTES = 2 << 20        # bytes of one suffix array
HOT_BYTES = 1 << 20          # bytes of the segments of one key in a shard
BLOCK = 32                   # starts of a hot key dealt together
SHARE = 10_000               # a fact is frequent above one in this many rows

_BYTE_HASH = mix64(np.arange(256, dtype=np.uint64), 77)
_FACTORS = [int(x) | 1 for x in mix64(np.arange(1, 9, dtype=np.uint64), 78)]


# --- segments --------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes, by doubling."""
    h, width, at = _BYTE_HASH[data], 1, 0
    while width < gram:
        with np.errstate(over="ignore"):
            h = h[:len(h) - width] * np.uint64(_FACTORS[at]) + h[width:]
        h ^= h >> np.uint64(29)
        width, at = 2 * width, at + 1
    return h


def over_windows(values: np.ndarray, width: int, choose=np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` consecutive values."""
    low, done = values, 1
    while 2 * done <= width:
        low = choose(low[:len(low) - done], low[done:])
        done *= 2
    rest = width - done
    return choose(low[:len(low) - rest], low[rest:]) if rest else low


def _occurrences(grams: np.ndarray, keys: np.ndarray, width: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each segment's key stands among its grams."""
    ends = np.zeros(width - 1, np.uint64)
    least = np.flatnonzero(grams == over_windows(np.concatenate([ends, keys, ends]), width, np.maximum))      # least of some window
    names, ranks = np.unique(grams[least], return_inverse=True)
    places = np.sort(ranks * len(grams) + least)
    mine = np.searchsorted(names, keys[first]) * len(grams) + first
    return np.searchsorted(places, mine + count + width - 1) - np.searchsorted(places, mine)


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, key, occurrences of the key) of the segments of the pieces ``[start, end)`` of ``data``."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, np.empty(0, np.uint64), none
    grams, width = gram_hashes(data), length - GRAM + 1
    keys = over_windows(grams, width)
    edge = np.zeros(len(keys) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(keys)))
    first, count = first[valid[first]], count[valid[first]]
    if len(count) and count.max() > RUN:
        parts = -(-count // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, left = np.repeat(first, parts) + step * RUN, np.repeat(count, parts) - step * RUN
        count = np.minimum(left, RUN)
    return first, count, keys[first], _occurrences(grams, keys, width, first, count)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, from, to) of the texts of a batch; long ones in pieces whose strings cover all starts."""
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        while end - start >= length:
            stop = min(end, start + BUFFER)
            yield row, start, stop
            if stop == end:
                break
            start = stop - length + 1


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """One row per segment: its document, first start, number of starts, key and hash of its bytes."""
    def found(b, data, offsets, group):
        # pieces are copied side by side; no string may cross their borders
        starts = np.array([0] + [stop - start for _, start, stop in group]).cumsum()
        buffer = np.concatenate([data[start:stop] for _, start, stop in group])
        first, count, keys, times = segments(buffer, starts[:-1], starts[1:], length)
        piece = np.searchsorted(starts, first, "right") - 1
        rows = np.array([row for row, _, _ in group])[piece]
        shift = np.array([start - int(offsets[row]) for row, start, _ in group])[piece] - starts[piece]
        raw, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
        names = np.fromiter((digest(raw[s:s + n + length - 1]) for s, n in zip(first.tolist(), count.tolist())), np.uint64, len(first))
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([b.column("row_a").take(at), b.column("row_b").take(at), pa.array(first + shift), pa.array(count.astype(np.int32)),
                                           pa.array(keys.view(np.int64)), pa.array(names.view(np.int64)), pa.array(times > 1)],
                                          ["row_a", "row_b", "start", "starts", "key", "seg", "inner"])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            text = b.column("text")
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            group, held = [], 0
            for piece in _pieces(offsets, length):
                group.append(piece)
                held += piece[2] - piece[1]
                if held >= BUFFER:
                    yield found(b, data, offsets, group)
                    group, held = [], 0
            if group:
                yield found(b, data, offsets, group)
    return docs.select("row_a", "row_b", "text").mapInArrow(run, "row_a bigint, row_b bigint, start bigint, starts int, key bigint, seg bigint, inner boolean")


# --- suffix arrays -------------------------------------------------------------------------------

def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j:j + len(data)]
    return out


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; ``left`` are the bytes from each position to the end of its segment.

    The end of a segment is less than any byte and differs from any other end.  Larsson-Sadakane: a position's rank is the
    first place of its group; groups of several are sorted by the ranks ``depth`` further on, and the depth doubles.
    """
    n = len(data)
    place = np.arange(n)
    words = words_at(data)
    short = np.flatnonzero(left < 8)
    words[short] &= ~((np.uint64(1) << ((8 - left[short]).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    tail = np.minimum(left, 8)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    # equal words: shorter suffixes first, and those of less than eight bytes end apart
    mixed = np.flatnonzero((sorted_words[1:] == sorted_words[:-1]) & ((tail[order[1:]] < 8) | (tail[order[:-1]] < 8)))
    if len(mixed):
        touched = np.isin(sorted_words, np.unique(sorted_words[mixed]))
        some = order[touched]
        order[touched] = some[np.lexsort((some, tail[some], words[some]))]
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (tail[order[1:]] < 8) | (tail[order[1:]] != tail[order[:-1]])
    depth = 8
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    while True:
        several = ~new
        several[:-1] |= ~new[1:]
        slots = np.flatnonzero(several)
        if not len(slots):
            return order
        some = order[slots]
        ends = left[some] == depth                    # nothing follows: first, and apart
        after = np.where(ends, 0, rank[np.minimum(some + depth, n - 1)] + 1)
        group = rank[some]
        sort = np.argsort(group * (n + 1) + after, kind="stable")
        some, after, group, ends = some[sort], after[sort], group[sort], ends[sort]
        order[slots] = some
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1]) | ends[1:]
        new[slots] = fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, slots, 0))
        depth *= 2


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading equal bytes (0 to 7) of words that differ, from their XOR."""
    out = np.zeros(len(x), np.int64)
    for j in range(7):
        out += x >> np.uint64(56 - 8 * j) == 0
    return out


def common_prefixes(words: np.ndarray, left: np.ndarray, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes in common with the suffix before, for the first ``counts`` positions of the segments at ``firsts`` (others: 0).

    Kasai's rule: the next position shares at least all but one byte of what this one shares.  All segments advance together.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    by_count = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[by_count], counts[by_count]
    shared = np.zeros(len(firsts), np.int64)
    for step in range(int(counts.max(initial=0))):
        active = int(np.searchsorted(-counts, -step, "left"))     # those with more than ``step`` starts
        p = firsts[:active] + step
        q = before[p]
        l = np.maximum(shared[:active] - 1, 0)
        most = np.where(q >= 0, np.minimum(left[p], left[q]), 0)
        l = np.minimum(l, most)
        go = np.flatnonzero(l < most)
        while len(go):
            x = words[p[go] + l[go]] ^ words[q[go] + l[go]]
            same = x == 0
            l[go] += np.where(same, 8, equal_bytes(x))
            go = go[same & (l[go] < most[go])]
        l = np.minimum(l, most)
        out[p] = l
        shared[:active] = l
    return out


class Shard:
    """The suffix array of some segments; ``repeats`` marks starts of strings that stand in it twice."""

    def __init__(self, contents: list[bytes], length: int):
        sizes = np.array([len(c) for c in contents])
        self.ends = sizes.cumsum()
        self.firsts, self.counts = self.ends - sizes, sizes - length + 1
        data = np.frombuffer(b"".join(contents), np.uint8)
        left = np.repeat(self.ends, sizes) - np.arange(len(data))
        self.length, self.words = length, words_at(data)
        order = suffix_array(data, left)
        shared = common_prefixes(self.words, left, order, self.firsts, self.counts)
        # a start's neighbour before it, and the one after it: both ends of a common prefix repeat
        joined = shared[order] >= length
        self.repeats = np.zeros(len(data), bool)
        self.repeats[order[joined]] = True
        self.repeats[order[np.flatnonzero(joined) - 1]] = True
        self.strings = order[left[order] >= length]

    def merge(self, other: Shard) -> None:
        """Mark what both shards hold: the strings of this one are searched for in the order of the other."""
        mine, theirs = self.strings, other.strings
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs), np.int64)
        if not len(theirs):
            return
        equal = np.full(len(mine), -1, np.int64)
        open_ = np.arange(len(mine))
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            sign = self._compare(mine[open_], other, theirs[middle])
            equal[open_[sign == 0]] = theirs[middle[sign == 0]]
            low[open_[sign > 0]] = middle[sign > 0] + 1
            high[open_[sign < 0]] = middle[sign < 0]
            open_ = open_[(sign != 0) & (low[open_] < high[open_])]
        met = equal >= 0
        self.repeats[mine[met]] = True
        other.repeats[equal[met]] = True            # others equal to it stand there twice and are marked already

    def _compare(self, p: np.ndarray, other: Shard, q: np.ndarray) -> np.ndarray:
        """Sign of each string at ``p`` against the one of ``other`` at ``q``."""
        sign, go = np.zeros(len(p), np.int8), np.arange(len(p))
        for at in [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]:
            x, y = self.words[p[go] + at], other.words[q[go] + at]
            sign[go] = np.where(x < y, -1, np.where(x > y, 1, 0))
            go = go[x == y]
            if not len(go):
                break
        return sign

    def spans(self) -> Iterator[list[dict[str, int]]]:
        """For every segment the runs of its repeated starts, counted from its first."""
        for first, count in zip(self.firsts.tolist(), self.counts.tolist()):
            yield _spans(self.repeats[first:first + count])


def _spans(marked: np.ndarray) -> list[dict[str, int]]:
    steps = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"lo": lo, "hi": hi - 1} for lo, hi in zip(steps[::2].tolist(), steps[1::2].tolist())]


_MARKS = "key bigint, seg bigint, n bigint, spans array<struct<lo: int, hi: int>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _marked(contents: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marks of the segments that stand once; rows of one ``shard`` number are together."""
    def marks(rows: list[tuple[int, int, int, bytes]]):
        shards, part, size = [], [], 0
        for row in rows:
            part.append(row)
            size += len(row[3])
            if size >= shard_bytes:
                shards.append(part)
                part, size = [], 0
        if part:
            shards.append(part)
        built = [Shard([r[3] for r in part], length) for part in shards]
        for i, shard in enumerate(built):
            for other in built[:i]:
                shard.merge(other)
        found = [(key, seg, spans) for part, shard in zip(shards, built) for (key, seg, n, _), spans in zip(part, shard.spans()) if n == 1 and spans]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                           pa.array([1] * len(found), pa.int64()), pa.array([f[2] for f in found], _SPANS)], ["key", "seg", "n", "spans"])

    def run(batches: Iterator[pa.RecordBatch]):
        current, rows = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "key", "seg", "n", "content"))):
                if shard != current:
                    if rows:
                        yield marks(rows)
                    current, rows = shard, []
                rows.append(row)
        if rows:
            yield marks(rows)
    return (contents.select("shard", "key", "seg", "n", "content").repartition("shard").sortWithinPartitions("shard", "key", "seg")
            .mapInArrow(run, _MARKS))


# --- joins on hot keys ----------------------------------------------------------------------------

def attach(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Inner join of ``rows`` with one fact per key; ``weight`` tells how many rows have the key.

    At most ``SHARE`` facts weigh more than one ``SHARE``-th of all: these are broadcast, so their rows stay where they are.
    """
    total = facts.agg(F.sum(weight)).first()[0]
    if not total:
        return rows.join(facts, keys)
    hot = F.broadcast(facts.where(F.col(weight) * SHARE > F.lit(total)))
    cold = facts.where(F.col(weight) * SHARE <= F.lit(total))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def _hot_blocks(contents: DataFrame, length: int) -> DataFrame:
    """Runs of starts of hot keys, named by the bytes all their strings have in common."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "content", 1 << 20):
            out = []
            for key, seg, n, content in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "n", "content"))):
                at = np.flatnonzero(gram_hashes(np.frombuffer(content, np.uint8)) == np.uint64(key & 0xFFFFFFFFFFFFFFFF))
                starts = np.arange(len(content) - length + 1)
                anchor = at[np.searchsorted(at, starts)]            # the leftmost gram that is the key
                block = anchor - (anchor - starts) // BLOCK * BLOCK     # last start of the block
                for stop in np.unique(block).tolist():
                    mine = starts[block == stop]
                    for a in np.unique(anchor[mine]).tolist():
                        run_ = mine[anchor[mine] == a]
                        core = content[stop:stop - BLOCK + 1 + length]
                        name = xxhash.xxh3_128_digest(core + (a - stop).to_bytes(4, "big") + key.to_bytes(8, "big", signed=True))
                        out.append((name, key, seg, n, int(run_[0]), int(run_[-1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             ["name", "key", "seg", "n", "lo", "hi"])
    return contents.select("key", "seg", "n", "content").mapInArrow(run, "name binary, key bigint, seg bigint, n bigint, lo int, hi int")


def _hot_strings(contents: DataFrame, length: int) -> DataFrame:
    """Single strings of hot keys, named by their bytes; ``runs`` are the starts in question."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "content", 1 << 18):
            out = [(xxhash.xxh3_128_digest(content[s:s + length]), key, seg, n, s, s)
                   for key, seg, n, content, runs in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "n", "content", "runs")))
                   for r in runs for s in range(r["lo"], r["hi"] + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             ["name", "key", "seg", "n", "lo", "hi"])
    return contents.select("key", "seg", "n", "content", "runs").mapInArrow(run, "name binary, key bigint, seg bigint, n bigint, lo int, hi int")


def _sharing(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` whose name stands in several rows, or in one segment that occurs several times."""
    rows = cut_lineage(rows)
    counts = cut_lineage(rows.groupBy("name").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 1"))
    return attach(rows, counts, ["name"], "rows").select("key", "seg", "n", "lo", "hi")


def _hot_marks(contents: DataFrame, length: int) -> DataFrame:
    """Marks of the segments of hot keys that stand once."""
    runs = F.collect_list(F.struct("lo", "hi"))
    blocks = _sharing(_hot_blocks(contents, length)).groupBy("key", "seg").agg(runs.alias("runs"))
    strings = _sharing(_hot_strings(contents.join(blocks, ["key", "seg"]), length))
    return strings.where("n = 1").groupBy("key", "seg").agg(F.first("n").alias("n"), runs.alias("spans"))


# --- the operator ----------------------------------------------------------------------------------

def repeated_spans(docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(row_a, row_b, spans) of every document with repeated strings; ``docs`` come from ``_identified``.

    ``spans`` are ranges [lo, hi) of bytes to remove, in no order; they may overlap.
    """
    cut = cut_lineage(_cut(docs, length))
    # ``first`` of all columns comes from one row; any copy of a segment will do
    segs = cut_lineage(cut.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("row_a", "row_b", "start", "starts", "inner"))))
    size = (F.col("starts") + (length - 1)).cast("bigint")
    keys = cut_lineage(segs.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum(size).alias("bytes"), F.bool_or(F.expr("inner and n = 1")).alias("inner"))
                       .where("different > 1 or inner").drop("inner"))
    asked = cut_lineage(attach(segs, keys, ["key"], "different"))
    total = asked.where(F.col("bytes") <= hot_bytes).agg(F.sum(size)).first()[0] or 0
    shards = -(-int(total) // shard_bytes) or 1
    refs = asked.groupBy("row_a", "row_b").agg(F.collect_list(F.struct("key", "seg", "n", "start", "starts", (F.col("bytes") > hot_bytes).alias("hot"))).alias("refs"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            out, held = [], 0
            for text, wanted in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("refs").to_pylist()):
                for r in wanted:
                    out.append((r["key"], r["seg"], r["n"], r["hot"], text[r["start"]:r["start"] + r["starts"] + length - 1]))
                    held += len(out[-1][4])
                    if held > 4 << 20:
                        yield batch(out)
                        out, held = [], 0
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                                          ["key", "seg", "n", "hot", "content"])
    # equal rows of one id give the same bytes twice
    contents = cut_lineage(docs.join(refs, ["row_a", "row_b"]).select("text", "refs")
                           .mapInArrow(run, "key bigint, seg bigint, n bigint, hot boolean, content binary")
                           .dropDuplicates(["key", "seg"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))))
    once = _marked(contents.where("not hot"), length, shard_bytes).unionByName(_hot_marks(contents.where("hot"), length))
    whole = segs.where("n > 1").select("key", "seg", "n", F.array(F.struct(F.lit(0).alias("lo"), (F.col("starts") - 1).alias("hi"))).alias("spans"))
    marks = cut_lineage(whole.unionByName(once))
    spans = attach(cut, marks, ["key", "seg"]).select("row_a", "row_b", F.transform("spans", lambda s: F.struct(
        (F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"] + length).alias("hi"))).alias("spans"))
    return spans.groupBy("row_a", "row_b").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _identified(docs: DataFrame) -> DataFrame:
    """(row_a, row_b, doc_id, text): 128 bits that name id and text."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(12), "text", "doc_id").alias("row_b"), "doc_id", "text")


def union(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Maximal ranges that the spans cover together."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(o) for o in out]


def without_repeats(docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, keep_bytes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256, and with ``keep_bytes`` the ``kept`` bytes and ``spans``.

    What is kept is a binary value: a span may start or end inside a character.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    rows = _identified(docs)
    spans = cut_lineage(repeated_spans(rows, length, shard_bytes, hot_bytes))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            out = []
            for doc_id, text, found in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                gone = union(found or [])
                borders = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(borders[::2], borders[1::2]))
                row = (doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append(row + (kept, [{"lo": lo, "hi": hi} for lo, hi in gone]) if keep_bytes else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            width = 7 if keep_bytes else 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(width)], names[:width])
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary, spans array<struct<lo: bigint, hi: bigint>>" if keep_bytes else ""
    return rows.join(spans, ["row_a", "row_b"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
