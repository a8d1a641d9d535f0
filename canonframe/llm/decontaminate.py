"""Operator 5, benchmark decontamination through the CGK embedding.

Texts are sequences of lower-case words.  Every benchmark item of ``n`` words is compared with the windows of ``n`` words
of a document.  The random walk of the CGK embedding (write the current word, step on or stay by a random bit of word and
step number) turns a window into a sequence of words such that few edits become few differing positions; items and windows
of a length share the walks.  Repeated samples of positions are the buckets of a locality-sensitive hash; a window and an
item in one bucket are a candidate, verified by their exact edit distance in words, the window's end being free.  Positions
are drawn from the steps nearly all walks take inside the text; a sample that falls behind the end of a walk has no bucket,
so only words that are equal bring a pair together.  Longer items get more walks, because equal stretches get rarer.

Windows that cannot be within the distance are not embedded: ``k`` edits leave at least ``n - 2 - 3 k`` of the item's word
triples unharmed (for short items ``n - k`` words), so a window with fewer triples of items of that length is none.  This
bound loses nothing.

The benchmark is taken in blocks of a bounded size, each of which is broadcast; a document is never moved.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, slices, texts

SIMILARITY = 0.8             # at most 1 - SIMILARITY edits per word of the item
WALKS = 12                   # independent walks for every WALK_WORDS words of an item, or part of them
WALK_WORDS = 100
SAMPLES = 12                 # samples of positions per walk
POSITIONS = 3                # positions per sample
BLOCK_ITEMS = 20_000         # items in one broadcast block
BLOCK_WORDS = 1 << 20        # words in one broadcast block (a longer item is a block of its own)

_PARTING = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text, parted by ASCII punctuation and white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTING).split()


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def steps_inside(n: int) -> int:
    """Steps that about 49 of 50 walks take within ``n`` words (a step goes on with a chance of one half)."""
    return max(n, int(2 * n - 2 * (2 * n) ** 0.5))


def prefix_distance(item: dict[int, int], n: int, window: list[int], k: int) -> tuple[int, int]:
    """(distance, words): least edit distance between an item and a beginning of ``window``, bit-parallel.

    ``item`` maps a word to the bits of its places.  Gives the first shortest beginning; ``k`` only bounds the search.
    """
    full = (1 << n) - 1
    high = 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, at = n, 0
    for j, word in enumerate(window, 1):
        eq = item.get(word, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = minus | ~(d0 | plus) & full
        hn = plus & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1 | 1) & full
        minus = hp & d0
        plus = (hn << 1 | ~(d0 | hp)) & full
        if score < best:
            best, at = score, j
        if j - n > k:
            break
    return best, at


class _Length:
    """Items of one number of words."""

    def __init__(self, n: int, items: list[tuple[int, list[int]]], k: int, vocabulary: int):
        self.n, self.k, self.items = n, k, items
        self.triples = n - 2 - 3 * k >= 1
        self.least = n - 2 - 3 * k if self.triples else n - k
        self.places, self.grams = [], []
        for _, w in items:
            bits: dict[int, int] = defaultdict(int)
            for p, x in enumerate(w):
                bits[x] |= 1 << p
            self.places.append(dict(bits))
            self.grams.append(set(zip(w, w[1:], w[2:])) if self.triples else set(w))
        rng = np.random.default_rng([17, n])
        self.steps = steps_inside(n)
        self.picks = [np.sort(rng.integers(0, self.steps, (SAMPLES, POSITIONS)), axis=1) for _ in range(WALKS * -(-n // WALK_WORDS))]
        mine, _ = self.keys(np.array([w for _, w in items], np.int64).reshape(len(items), n))
        self.order = np.argsort(mine, axis=0, kind="stable")
        self.sorted = np.take_along_axis(mine, self.order, axis=0)

    def keys(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers (windows, samples of all walks), and which of them lie inside the text."""
        m, n = windows.shape
        padded = np.hstack([windows, np.full((m, 1), -1)])
        rows, out, inside = np.arange(m), [], []
        for walk, picks in enumerate(self.picks):
            at, written = np.zeros(m, np.int64), np.empty((m, self.steps), np.int64)
            ends = np.full(m, self.steps)                               # the step at which the walk leaves the text
            for step in range(self.steps):
                word = padded[rows, at]
                written[:, step] = word
                bit = mix64(word.view(np.uint64), (walk * 4096 + step) * 65_537 + n) & np.uint64(1)
                np.minimum(at + bit.astype(np.int64), n, out=at)
                ends[(at == n) & (ends > step)] = step + 1
            for s, pick in enumerate(picks):
                key = np.full(m, walk * SAMPLES + s, np.uint64)
                for p in pick:
                    key = mix64(key ^ written[:, p].view(np.uint64), int(p) + 1)
                out.append(key)
                inside.append(pick[-1] < ends)                          # positions ascend
        return np.stack(out, axis=1), np.stack(inside, axis=1)

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) that share a bucket."""
        keys, inside = self.keys(windows)
        found = []
        for t in range(keys.shape[1]):
            low = np.searchsorted(self.sorted[:, t], keys[:, t], "left")
            high = np.searchsorted(self.sorted[:, t], keys[:, t], "right")
            hit = np.flatnonzero((high > low) & inside[:, t])
            count = high[hit] - low[hit]
            rows = np.repeat(hit, count)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            found.append(rows * len(self.items) + self.order[np.repeat(low[hit], count) + within, t])
        for pair in np.unique(np.concatenate(found)).tolist() if found else []:
            yield divmod(pair, len(self.items))


class ItemIndex:
    """A block of items, ready to be searched for in batches of documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.raw, self.similarity = items, similarity

    def __getstate__(self):
        return {"raw": self.raw, "similarity": self.similarity}

    @cached_property
    def tables(self):
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = defaultdict(list)
        for item_id, text in self.raw:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            if words:
                by_length[len(words)].append((item_id, words))
        size = len(vocabulary) + 1
        lengths = [_Length(n, items, edits_allowed(n, self.similarity), size) for n, items in sorted(by_length.items())]
        grams: dict[bool, tuple] = {}
        for triples in (True, False):
            pairs = set()
            for number, group in enumerate(lengths):
                if group.triples == triples:
                    for g in group.grams:
                        pairs.update((self._gram(x, size) if triples else x, number) for x in g)
            ordered = np.array(sorted(pairs), np.int64).reshape(len(pairs), 2)
            keys, first = np.unique(ordered[:, 0], return_index=True)
            grams[triples] = keys, np.append(first, len(ordered)), ordered[:, 1]
        return vocabulary, size, lengths, grams

    @staticmethod
    def _gram(x: tuple[int, int, int], size: int) -> int:
        return (x[0] * size + x[1]) * size + x[2]

    def find(self, batch: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """Per text the items it holds: (item_id, distance, item's words, first word, words of the text)."""
        vocabulary, size, lengths, grams = self.tables
        out: list[list] = [[] for _ in batch]
        if not lengths:
            return out
        split = [words_of(t) for t in batch]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        begins = np.cumsum(counts + 1) - counts - 1                     # a zero parts the texts
        ids = np.zeros(int((counts + 1).sum()) + 2, np.int64)
        for words, begin in zip(split, begins.tolist()):
            ids[begin:begin + len(words)] = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        for triples in (True, False):
            keys, first, owners = grams[triples]
            if not len(keys):
                continue
            if triples:
                at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
                got = (ids[at] * size + ids[at + 1]) * size + ids[at + 2]
            else:
                at = np.flatnonzero(ids > 0)
                got = ids[at]
            hit = np.searchsorted(keys, got)
            good = keys[np.minimum(hit, len(keys) - 1)] == got
            at, hit = at[good], hit[good]
            n_owners = first[hit + 1] - first[hit]
            where = np.repeat(at, n_owners)
            within = np.arange(len(where)) - np.repeat(np.cumsum(n_owners) - n_owners, n_owners)
            owner = owners[np.repeat(first[hit], n_owners) + within]
            order = np.argsort(owner, kind="stable")
            bounds = np.flatnonzero(np.diff(owner[order], prepend=-1))
            for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
                places[int(owner[order[s]])].append(where[order[s:e]])
        best: dict[tuple[int, int], tuple] = {}
        for number in sorted(places):
            group = lengths[number]
            self._search(group, np.sort(np.concatenate(places[number])), ids, begins, counts, best)
        for (doc, item_id), (distance, first_word, n, used) in sorted(best.items()):
            out[doc].append((item_id, distance, n, first_word, used))
        return out

    @staticmethod
    def _search(group: _Length, at: np.ndarray, ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, best: dict) -> None:
        n, k, least = group.n, group.k, group.least
        reach = n - 2 if group.triples else n                           # grams that begin inside a window
        if len(at) < least:
            return
        # Every start whose window holds enough grams lies within ``reach`` before the first of ``least`` close ones.
        close = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] < reach)
        if not len(close):
            return
        starts = np.unique((at[close][:, None] - np.arange(reach)).ravel())
        starts = starts[starts >= 0]
        held = np.searchsorted(at, starts + reach) - np.searchsorted(at, starts)
        starts, held = starts[held >= least], held[held >= least]
        if not len(starts):
            return
        order = np.argsort(-held, kind="stable")                        # likeliest first
        starts = starts[order]
        doc = np.searchsorted(begins, starts, "right") - 1
        ends = begins[doc] + counts[doc]
        inside = starts < ends
        starts, doc, ends = starts[inside], doc[inside], ends[inside]
        for s in range(0, len(starts), 20_000):
            first, owner, stop = starts[s:s + 20_000], doc[s:s + 20_000], ends[s:s + 20_000]
            spots = first[:, None] + np.arange(n)
            windows = np.where(spots < stop[:, None], ids[np.minimum(spots, len(ids) - 1)], 0)
            for w, i in group.candidates(windows):
                key = (int(owner[w]), group.items[i][0])
                known = best.get(key)
                if known is not None and known[0] == 0:
                    continue
                words = ids[first[w]:min(first[w] + n + k, stop[w])].tolist()
                grams = group.grams[i]
                shared = sum(g in grams for g in (zip(words, words[1:], words[2:]) if group.triples else words))
                if shared < least and len(grams) >= least:
                    continue
                distance, used = prefix_distance(group.places[i], n, words, k)
                found = (distance, int(first[w] - begins[owner[w]]), n, used)
                if distance <= k and (known is None or found < known):
                    best[key] = found


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark, streamed in bounded lists.  Rows without id or text hold nothing that can leak."""
    block, words = [], 0
    rows = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for row in rows.distinct().toLocalIterator():
        size = row["t"].count(" ") + 1
        if block and (len(block) >= most or words + size > BLOCK_WORDS):
            yield block
            block, words = [], 0
        block.append((row["i"], row["t"]))
        words += size
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, n_words): the best place of every item a document holds.

    A place is a run of words within ``(1 - similarity) * item_words`` word edits of the item; ties go to the earlier
    one.  Null and wordless texts hold none, repeated rows report each, items without words match nothing.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, distance int, item_words int, first_word int, n_words int"
    found = spark.createDataFrame([], schema)
    for block in blocks(items, most=block_items):
        shared = spark.sparkContext.broadcast(ItemIndex(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            for b in slices(batches):
                rows = [(d, *hit) for d, hits in zip(b.column("doc_id").to_pylist(), shared.value.find(b.column("text").to_pylist())) for hit in hits]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)],
                                                 ["doc_id", "item_id", "distance", "item_words", "first_word", "n_words"])
        found = found.unionByName(texts(docs).mapInArrow(run, schema))
    return found


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for block in blocks(items, most=block_items):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            for b in slices(batches):
                yield b.filter(pa.array([not hits for hits in shared.value.find(b.column("text").to_pylist())], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
