"""Operator 1, SimHash near-dedup over BK-trees.

A text's fingerprint is the bitwise majority of its word shingles' hashes.  Distinct fingerprints are dealt to shards by
parts of their bits; a shard is one BK-tree (children keyed by the integer Hamming distance to their parent) whose search
follows only the edges within the radius.  A shard's rows and its tree meet in one task through a shuffle: broadcasting
the trees from the driver would take every fingerprint through the driver.

``linked_classes`` is exact: with ``radius`` differing bits, one of ``radius + 1`` blocks of bits is equal (pigeonhole),
so every linked pair shares a shard.  A shard above ``shard_rows`` fingerprints is dealt again by blocks of its remaining
bits, which is exact for the same reason; three deals leave at most 19 free bits, 2**19 fingerprints, in any shard.

``near_classes`` serves Jaccard similarity of five-word shingle sets, and is exact whatever the sizes.  Links that BK-trees over
the sets' fingerprints propose are confirmed first.  Then the rest is searched: shingles have one global order, common ones
last; a pair of similarity ``t`` shares one of the first ``n - ceil(t n) + 1`` shingles of both sets, so these are its shards.
Inside a shard a lower bound of the sets' difference (parity bitmaps of four bits a shingle) proposes pairs, and every
proposed pair is checked on the whole sets before it links.  A shard above ``shard_rows`` is searched block against block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut_lineage, mix64, slices, texts

SHARD_ROWS = 16_384          # fingerprints in one BK-tree before its shard is dealt again
MOST_BITS = 1 << 14          # of a parity bitmap
TEXT_SLICE = 1 << 20         # bytes of texts whose shingle sets are held at once
OWN_TREE = 32                # members from which a component of a shard gets a tree of its own


# --- fingerprints ---------------------------------------------------------------------------

def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; fewer words: the whole run; none: empty.

    A-Z are lower-cased; words are runs without ASCII white space (what ``bytes.lower`` and ``bytes.split`` do).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n - width + 1].tolist(), ends[width - 1:].tolist())],
                    np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """``8 * words`` big-endian bytes; a bit is 1 when it is set in over half of the hashes (further words mix them)."""
    n, total = len(hashes), np.zeros(64 * words, np.int64)
    for start in range(0, n, 255 * 32):
        part = hashes[start:start + 255 * 32]
        spread = part if words == 1 else np.stack([part] + [mix64(part, w) for w in range(1, words)], axis=1)
        bits = np.unpackbits(spread.astype(">u8").view(np.uint8).reshape(len(part), 8 * words), axis=1)
        for s in range(0, len(part), 255):       # 255 rows cannot overflow a byte
            total += bits[s:s + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint): 16 hex digits per row of ``docs``; null or wordless text gives zeros."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            out = [majority(shingle_hashes(t, width)).hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])
    return texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


# --- BK-trees ---------------------------------------------------------------------------------

class BKTree:
    """Values under integer Hamming distance; ``payload`` is what ``accept`` and callers need of a value."""

    def __init__(self):
        self.values: list[int] = []
        self.payload: list = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int, payload) -> None:
        new = len(self.values)
        self.values.append(value)
        self.payload.append(payload)
        self.children.append({})
        at = 0
        while at < new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)

    def search(self, value: int, radius: int) -> Iterator[tuple[int, object]]:
        """(distance, payload) of the values within ``radius``; only edges that can hold one are followed."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield d, self.payload[at]
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def shard_links(members: list[tuple[int, int, int]], radius: int, accept: Callable[[int, int, int], bool]) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard; ``members`` are (id, value, size).

    Components of ``OWN_TREE`` members have their own tree, in which a search stops at the first link; smaller ones
    share a tree that is searched whole.  So a dense shard costs far less than its pairs, and no connection is lost.
    """
    parent: dict[int, int] = {}
    held: dict[int, list] = {}
    own: dict[int, BKTree] = {}
    shared = BKTree()
    links = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for member in sorted(members):
        ident, value, size = member
        if ident in parent:
            continue
        parent[ident], held[ident] = ident, [member]
        hits = set()
        for top, tree in own.items():
            if any(accept(d, size, m[2]) for d, m in tree.search(value, radius)):
                hits.add(top)
        for d, m in shared.search(value, radius):
            if accept(d, size, m[2]):
                top = root(m[0])
                if top not in own:
                    hits.add(top)
        links.extend((ident, top) for top in hits)
        group = hits | {ident}
        keep = max(group, key=lambda g: len(held[g]))
        for g in group - {keep}:
            parent[g] = keep
            if keep in own:
                for m in held[g]:
                    own[keep].insert(m[1], m)
                own.pop(g, None)
            held[keep] += held.pop(g)
        if keep not in own:
            if len(held[keep]) >= OWN_TREE:
                own[keep] = BKTree()
                for m in held[keep]:
                    own[keep].insert(m[1], m)
            else:
                shared.insert(value, member)
    return links


# --- dealing to shards --------------------------------------------------------------------------

def _blocks(free: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, p)) for p in np.array_split(np.array(free), parts)]


def _mask(bits: list[int], words: int) -> np.ndarray:
    m = np.zeros(64 * words, np.uint8)
    m[bits] = 1
    return np.packbits(m).view(">u8").astype(np.uint64)


class Pigeonhole:
    """Deal by the blocks of the bits that are still free; exact for ``radius``."""

    levels = 3

    def __init__(self, radius: int = 2, words: int = 1):
        self.parts, self.words = radius + 1, words

    def masks(self, level: int, path: int) -> list[tuple[int, np.ndarray]]:
        free = list(range(64 * self.words))
        for lv in range(level):
            digit = path // self.parts ** lv % self.parts
            gone = set(_blocks(free, self.parts)[digit])
            free = [b for b in free if b not in gone]
        return [(path + j * self.parts ** level, _mask(bits, self.words)) for j, bits in enumerate(_blocks(free, self.parts))]


_DEALT = "id bigint, path bigint, shard bigint"


def _deal(rows: DataFrame, plan, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            value = np.frombuffer(b"".join(b.column("value").to_pylist()), ">u8").reshape(b.num_rows, plan.words).astype(np.uint64)
            path = b.column("path").to_numpy()
            shard = b.column("shard").to_numpy().view(np.uint64)
            for p in np.unique(path):
                at = np.flatnonzero(path == p)
                ident = b.column("id").take(pa.array(at))
                for new_path, mask in plan.masks(level, int(p)):
                    key = mix64(shard[at], level + 1)
                    for w in range(plan.words):
                        key = mix64(key ^ (value[at, w] & mask[w]), (new_path % 1_000_003) + 7 * w + 1)
                    yield pa.RecordBatch.from_arrays([ident, pa.array(np.full(len(at), new_path, np.int64)), pa.array(key.view(np.int64))],
                                                     ["id", "path", "shard"])
    return rows.mapInArrow(run, _DEALT)


def _search(rows: DataFrame, radius: int, accept) -> DataFrame:
    """Links inside each shard; one shard's rows are together and in order."""
    def run(batches: Iterator[pa.RecordBatch]):
        current, members, links = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())],
                                              ["a", "b"])
        for b in batches:
            for shard, ident, value, size in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "value", "size"))):
                if shard != current:
                    if len(members) > 1:
                        links += shard_links(members, radius, accept)
                    current, members = shard, []
                members.append((ident, int.from_bytes(value, "big"), size))
            if len(links) > 50_000:
                yield batch()
                links = []
        if len(members) > 1:
            links += shard_links(members, radius, accept)
        yield batch()
    return (rows.select("shard", "id", "value", "size").repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(run, "a bigint, b bigint"))


def similar_links(nodes: DataFrame, plan, radius: int, accept, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect all nodes (id, value, size) which share a shard and are accepted.

    What is dealt is ids alone.  Shards of one row are dropped by an aggregate, and only the rest fetch their values.
    Shards of more than ``shard_rows`` rows are dealt again up to ``plan.levels`` times.
    """
    nodes = nodes.select("id", "value", "size")
    rows = nodes.withColumn("path", F.lit(0).cast("bigint")).withColumn("shard", F.lit(0).cast("bigint"))
    found = None
    for level in range(plan.levels):
        dealt = cut_lineage(_deal(rows, plan, level))
        counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = level == plan.levels - 1
        small = counts if last else counts.where(f"n <= {shard_rows}")
        links = cut_lineage(_search(dealt.join(small.drop("n"), "shard").join(nodes, "id"), radius, accept))
        found = links if found is None else found.unionByName(links)
        large = counts.where(f"n > {shard_rows}").drop("n")
        if last or large.isEmpty():
            break
        rows = dealt.join(large, "shard").join(nodes, "id")
    return found


# --- the two operators ----------------------------------------------------------------------------

def linked_classes(docs: DataFrame, radius: int = 2, width: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: documents whose fingerprints are joined by links of ``radius`` bits.

    ``component_id`` is the smallest doc_id of the class.  Null and empty texts have fingerprint zero and link like any
    other; repeated rows stay; a null doc_id takes part but never is the smallest (null if the class has no other).
    """
    prints = cut_lineage(fingerprints(docs, width))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select(
        "fingerprint", "least", F.unhex("fingerprint").alias("value"),
        F.expr("conv(fingerprint, 16, -10)").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("size")))
    links = similar_links(distinct, Pigeonhole(radius), radius, lambda d, a, b: True, shard_rows)
    roots = components(links)
    named = (distinct.select("fingerprint", "least", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .select("fingerprint", "least", F.coalesce("root", "id").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _grams(docs: DataFrame, width: int, keep: str) -> DataFrame:
    """``keep`` (a bigint or string column) and ``grams``, the sorted set of the text's shingles."""
    kind = dict(docs.dtypes)[keep]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, most=TEXT_SLICE):
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(sets, pa.list_(pa.int64()))], [keep, "grams"])
    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, grams array<bigint>")


def common_grams(docs: DataFrame, width: int, sample: int = 8192, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more texts of a bounded sample hold, sorted, and how many do.

    They only order the shingles: any order finds all pairs, one with common shingles last finds few others.
    """
    rate = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0).select("text").distinct().withColumn("key", F.lit(0))
    rows = (_grams(some, width, "key").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 2").orderBy(F.desc("n"), "gram").limit(most).collect())
    found = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["n"] for r in rows], np.int64)[order]


def prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """The first shingles in global order, of which any set of similarity ``threshold`` has one among its own first."""
    n = len(grams)
    if not n:
        return grams
    names, counts = common
    times = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
        times = np.where(names[at] == grams, counts[at], 0)
    return grams[np.lexsort((mix64(grams, 9), times))[:n - math.ceil(threshold * n - 1e-9) + 1]]


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each of a power of two of buckets, four or more a shingle up to ``MOST_BITS``: whether it holds an odd number."""
    bits = min(max(128, 1 << (4 * len(hashes) - 1).bit_length() if len(hashes) else 0), MOST_BITS)
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of some sets, compared at the smaller of two sizes (halves of the larger are folded by XOR)."""

    def __init__(self, values: list[bytes]):
        self.bytes = np.array([len(v) for v in values])
        self.place, self.whole, self.half = np.zeros(len(values), np.int64), {}, {}
        for n in np.unique(self.bytes).tolist():
            mine = np.flatnonzero(self.bytes == n)
            self.place[mine] = np.arange(len(mine))
            self.whole[n] = np.frombuffer(b"".join(values[i] for i in mine.tolist()), np.uint64).reshape(len(mine), -1)
            middle = self.whole[n].shape[1] // 2
            self.half[n] = self.whole[n][:, :middle] ^ self.whole[n][:, middle:]

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """Bits that differ between x and each of ``others``: never more than the shingles that do."""
        n, at = int(self.bytes[x]), self.place[x]
        out = np.zeros(len(others), np.int64)         # 0 for sizes that are not neighbours, which no similar sets have
        for size, mine, theirs in ((n, self.whole, self.whole), (2 * n, self.whole, self.half), (n // 2, self.half, self.whole)):
            some = np.flatnonzero(self.bytes[others] == size)
            for s in range(0, len(some), 1024):
                part = some[s:s + 1024]
                out[part] = np.bitwise_count(theirs[size][self.place[others[part]]] ^ mine[n][at]).sum(axis=1, dtype=np.int64)
        return out


def _plausible(x: int, others: np.ndarray, values: Bitmaps, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Those of ``others`` that may be similar to ``x``; similar ones are never left out.

    Sets differ in at least as many shingles as their bitmaps in bits, and similar sets differ in at most
    ``(1 - t) / (1 + t)`` of their sizes' sum.
    """
    size = sizes[x]
    others = others[np.minimum(sizes[others], size) >= threshold * np.maximum(sizes[others], size) - 1e-9]
    return others[values.apart(x, others) <= (1 - threshold) / (1 + threshold) * (sizes[others] + size) + 1e-9]


def shard_forest(values: Bitmaps, sizes: np.ndarray, roots: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Plausible pairs (positions) that make one tree of each set of plausible neighbours and of members with one root.

    A dense shard costs far less than its pairs.
    """
    fresh, links = np.ones(len(sizes), bool), []
    for start in range(len(sizes)):
        if not fresh[start]:
            continue
        fresh[start] = False
        ahead = [start]
        while ahead:
            x = ahead.pop()
            left = np.flatnonzero(fresh)
            mates = left[roots[left] == roots[x]]
            near = _plausible(x, left[roots[left] != roots[x]], values, sizes, threshold)
            fresh[mates] = fresh[near] = False
            links += [(x, y) for y in near.tolist()]
            ahead += mates.tolist() + near.tolist()
    return links


def shard_crossings(values: Bitmaps, sizes: np.ndarray, roots: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """All plausible pairs (positions) of members with different roots."""
    names, counts = np.unique(roots, return_counts=True)
    widest = roots == names[counts.argmax()]
    place, links = np.arange(len(sizes)), []
    for x in np.flatnonzero(~widest).tolist():
        others = np.flatnonzero((roots != roots[x]) & (widest | (place > x)))
        links += [(x, y) for y in _plausible(x, others, values, sizes, threshold).tolist()]
    return links


def _shared(nodes: DataFrame) -> DataFrame:
    """(id, shard, n): the members of shards of several, and how many these are."""
    def run(batches: Iterator[pa.RecordBatch]):
        shards, ids = np.empty(0, np.int64), np.empty(0, np.int64)

        def several(shards, ids):
            _, at, n = np.unique(shards, return_inverse=True, return_counts=True)
            n = n[at] if len(at) else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[n > 1]), pa.array(shards[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["id", "shard", "n"])
        for b in batches:
            shards, ids = np.append(shards, b.column("shard").to_numpy()), np.append(ids, b.column("id").to_numpy())
            if len(shards):
                end = np.searchsorted(shards, shards[-1])       # the last shard may go on in the next batch
                if end:
                    yield several(shards[:end], ids[:end])
                    shards, ids = shards[end:], ids[end:]
        yield several(shards, ids)
    return (nodes.select("id", F.explode("prefix").alias("shard")).repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(run, "id bigint, shard bigint, n bigint"))


def _proposals(members: DataFrame, nodes: DataFrame, threshold: float, shard_rows: int, search) -> DataFrame:
    """Distinct plausible pairs (a < b) of ``members`` (id, shard, n, root) that ``search`` finds in each shard."""
    names = ["shard", "part", "id", "size", "value", "root"]

    def pairs(rows):
        ids, sizes, roots = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 5))
        if (roots == roots[0]).all():
            return []
        return [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in search(Bitmaps([r[4] for r in rows]), sizes, roots, threshold)]

    def batch(links):
        return pa.RecordBatch.from_arrays([pa.array([l[k] for l in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        current, rows, links = None, [], []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                if row[:2] != current:
                    links += pairs(rows) if len(rows) > 1 else []
                    current, rows = row[:2], []
                    if len(links) > 50_000:
                        yield batch(links)
                        links = []
                rows.append(row)
        yield batch(links + (pairs(rows) if len(rows) > 1 else []))

    # A shard of g blocks has a part for each two blocks, so any two of its members meet.
    blocks = members.withColumn("g", F.ceil(F.col("n") / shard_rows)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")))
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1), lambda j: F.least("mine", j) * F.col("g") + F.greatest("mine", j))
    return (blocks.withColumn("part", F.explode(parts)).join(nodes.select("id", "size", "value"), "id").select(*names)
            .repartition("shard", "part").sortWithinPartitions("shard", "part", "id").mapInArrow(run, "a bigint, b bigint").distinct())


def _confirmed(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs whose whole sets of shingles have the similarity; sets are made again from the texts of these ids alone."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = nodes.select("id", "text_key").join(asked, "id")
    rows = keyed.join(wanted, "text_key").groupBy("id").agg(F.first("text").alias("text"))
    sets = cut_lineage(_grams(rows, width, "id"))
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
            .select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum")))
    return both.where(F.col("n") >= threshold * (F.col("sum") - F.col("n")) - 1e-9).select("a", "b")


def _print_pairs(nodes: DataFrame, threshold: float, radius: int, shard_rows: int) -> DataFrame:
    """Distinct pairs (a < b) that equal fingerprints and BK-trees over distinct ones propose."""
    least = nodes.where("size > 0").groupBy("print").agg(F.min("id").alias("low"), F.min("size").alias("size"))
    least = cut_lineage(least)
    equal = nodes.where("size > 0").join(least.select("print", "low"), "print").where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    distinct = least.select(F.col("low").alias("id"), F.col("print").alias("value"), "size")
    links = similar_links(distinct, Pigeonhole(radius), radius, lambda d, a, b: True, shard_rows)
    return equal.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, shard_rows: int = SHARD_ROWS, radius: int = 2) -> DataFrame:
    """(text_key, least, root) per distinct text: its class under Jaccard similarity of its sets of five-word shingles.

    ``least`` is the smallest doc_id with that text.  Texts that are equal are one node whatever their words are; texts
    without words are one class.  Three searches, each confirmed on whole sets: fingerprints within ``radius`` bits; a forest
    of each shard over what they left apart; then all pairs of a shard that are still apart, so a proposal that was not
    confirmed hides no other.
    """
    keyed = texts(docs).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(common_grams(keyed, width))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, most=TEXT_SLICE):
            sets = [np.unique(shingle_hashes(t, width)) for t in b.column("text").to_pylist()]
            first = [prefix(h, shared.value, threshold).view(np.int64) if len(h) else np.zeros(1, np.int64) for h in sets]     # no words: one shard
            yield pa.RecordBatch.from_arrays([b.column("text_key"), b.column("doc_id"), pa.array(map(parity_bitmap, sets), pa.binary()), pa.array(map(len, sets), pa.int64()),
                                              pa.array(first, pa.list_(pa.int64())), pa.array(map(majority, sets), pa.binary())],
                                             ["text_key", "doc_id", "value", "size", "prefix", "print"])

    sketched = keyed.mapInArrow(run, "text_key string, doc_id bigint, value binary, size bigint, prefix array<bigint>, print binary")
    nodes = cut_lineage(sketched.groupBy("text_key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("value", "size", "prefix", "print")))
                        .withColumn("id", F.monotonically_increasing_id()))
    members = cut_lineage(_shared(nodes))

    def apart(links: DataFrame) -> DataFrame:
        """The members of shards that hold several classes, with their class."""
        rooted = members.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = rooted.groupBy("shard").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shard")
        return rooted.join(several, "shard")

    tried = cut_lineage(_print_pairs(nodes, threshold, radius, shard_rows))
    links = cut_lineage(_confirmed(tried, nodes, keyed, width, threshold))
    for search in (shard_forest, shard_crossings):
        more = cut_lineage(_proposals(apart(links), nodes, threshold, shard_rows, search).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(cut_lineage(_confirmed(more, nodes, keyed, width, threshold)))
            tried = tried.unionByName(more)
    roots = components(links)
    return (nodes.select("text_key", "least", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select("text_key", "least", F.coalesce("root", "id").alias("root")))


def keep_one(docs: DataFrame, threshold: float = 0.8, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate class: the one with the smallest doc_id stays.

    All columns are kept.  Repeated rows are copies like any other; of rows with one id and text the least by the JSON of their
    other columns stays.  Documents without words are each other's copies.
    """
    classes = cut_lineage(near_classes(docs, threshold, shard_rows=shard_rows))
    empty_last = F.struct(F.col("least").isNull(), F.col("least"), F.col("text_key"))
    kept = classes.groupBy("root").agg(F.min(empty_last).alias("k")).select(F.col("k.text_key").alias("_cf_key"), F.col("k.least").alias("_cf_least"))
    keyed = docs.withColumn("_cf_key", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    rows = keyed.join(kept, "_cf_key").where(F.col("doc_id").cast("bigint").eqNullSafe(F.col("_cf_least")))
    # rows of one id and text: the least by their other columns
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "doc_id")), F.lit(0).alias("_cf_0")))
    return rows.groupBy("_cf_key").agg(F.min_by(F.struct(*docs.columns), others).alias("_cf_row")).select("_cf_row.*")
