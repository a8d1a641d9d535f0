"""Operator 3, token-ID output coded by a canonical length-limited Huffman code.

1. Texts are tokenised once into a written table; the ids' global counts (one row per id, so bounded by the vocabulary)
   give code lengths of at most ``LIMIT`` bits by package-merge on the driver.
2. Each document becomes byte-aligned bits; the bit offset of every ``BLOCK``-th id is a checkpoint, so blocks decode
   independently.  Documents are dealt by doc_id ranges, sorted and packed into segments.
3. A file is a Parquet row ``(file, segment, data)`` that Spark writes to shared storage; ``data`` is the binary segment
   (see ``Segment``), the code lengths are a table beside it.  ``read_tokens`` decodes all blocks of a segment in step by
   table look-ups.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut_lineage, shared_folder, slices, texts

LIMIT = 20                   # longest code
BLOCK = 1024                 # ids between two checkpoints
SEGMENT = 1 << 20            # ids after which a segment is closed (a longer document is a segment of its own)
FILE_IDS = 1 << 24           # ids per file, on average
END = 0                      # id after each document
MEMO = 200_000               # chunks remembered in each of two generations
MEMO_CHARS = 64


# --- tokenising ------------------------------------------------------------------------------------

class ByteLevel:
    """Ids of whole texts by the tokenizers library's model, each distinct chunk once.

    A single space or line break between two other characters always ends a pre-token, so chunks between them are
    independent; texts with longer runs of white space are cut by the file's own pattern throughout.
    """

    # fixed value: the pattern of byte-level pre-tokenising
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("only byte-level files without normalisation and prefix are supported")
        self.model = Tokenizer.from_file(path).model
        self.find = regex.compile(self.PATTERN).findall
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("stripping added tokens are not supported")
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        top = max([*spec["model"]["vocab"].values(), *added.values()])
        self.kind = "H" if top < 1 << 16 else "I"
        self.end = array(self.kind, [END]).tobytes()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _pretokens(self, s: str) -> bytes:
        ids = array(self.kind)
        for part in self.find(s):
            ids.extend([t.id for t in self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.letters))])
        return ids.tobytes()

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``."""
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isascii() and chunk.isalpha():          # one pre-token, written as it is
                ids = array(self.kind, [t.id for t in self.model.tokenize(self.letters[32] + chunk)]).tobytes()
            elif chunk[-1] in ",." and chunk[:-1].isalpha():  # letters and a mark are two pre-tokens
                ids = (self.memo.get(chunk[:-1]) or self._spaced(chunk[:-1])) + (self.bare.get(chunk[-1]) or self._bare(chunk[-1]))
            else:
                ids = self._pretokens(" " + chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[chunk] = ids
        return ids

    def _bare(self, chunk: str) -> bytes:
        ids = self._pretokens(chunk)
        if len(self.bare) >= MEMO // 4:
            self.bare.clear()
        if len(chunk) <= MEMO_CHARS:
            self.bare[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids and the end id of any text, as machine-order numbers of type ``kind``."""
        if not text:
            return self.end
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(array(self.kind, [self.added[p]]).tobytes() if p in self.added else self._pretokens(p) for p in parts if p) + self.end

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """``encode`` of every text of a column.

        Chunks are numbered by Arrow, each distinct one is looked up once, and the ids are gathered by number.  Texts with
        added tokens or longer runs of white space are left to ``encode``.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        plain = np.ones(len(column), bool)
        for token in self.added:
            plain &= ~pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        by_line = pc.split_pattern(column, "\n")
        by_word = pc.split_pattern(by_line.flatten(), " ")
        coded = by_word.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int32)
        trimmed = pc.utf8_trim_whitespace(coded.dictionary)
        unsafe = pc.or_(pc.not_equal(trimmed, coded.dictionary), pc.equal(trimmed, "")).to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        words_end, lines_end = by_word.offsets.to_numpy()[1:], by_line.offsets.to_numpy()[1:]
        first = by_word.offsets.to_numpy()[:-1]                          # the first chunk of a line follows no space
        if unsafe.any():
            line_of = np.searchsorted(words_end, np.flatnonzero(unsafe[code]), "right")
            plain[np.searchsorted(lines_end, line_of, "right")] = False
        alone = np.zeros(len(distinct), bool)
        alone[code[first]] = True
        alone &= ~unsafe
        after_space = np.ones(len(code), bool)
        after_space[first] = False
        spaced = np.zeros(len(distinct), bool)
        spaced[code[after_space]] = True
        spaced &= ~unsafe
        entries, bare = list(map(self.memo.get, distinct)), self.bare.get
        for i in [i for i, known in enumerate(entries) if known is None]:
            entries[i] = self._spaced(distinct[i]) if spaced[i] else b""
        numbers = np.flatnonzero(alone)
        entries += [bare(distinct[i]) or self._bare(distinct[i]) for i in numbers.tolist()] + [self.newline, self.end]
        bare_number = np.zeros(len(distinct), np.int32)
        bare_number[numbers] = len(distinct) + np.arange(len(numbers))
        code[first] = np.where(alone[code[first]], bare_number[code[first]], code[first])
        # One more entry at the end of each line: a line break, or the end id after a text's last line.
        n_lines = len(words_end)
        sequence = np.full(len(code) + n_lines, len(entries) - 2, np.int32)
        sequence[words_end[lines_end - 1] + lines_end - 1] = len(entries) - 1
        sequence[np.arange(len(code)) + np.repeat(np.arange(n_lines), words_end - first)] = code
        flat = np.frombuffer(b"".join(entries), np.uint16 if self.kind == "H" else np.uint32)
        width = flat.itemsize
        length = np.fromiter(map(len, entries), np.int64, len(entries)) // width
        begin = np.cumsum(length) - length
        steps = length[sequence]
        ends = np.cumsum(steps)
        ids = flat[np.repeat(begin[sequence] - ends + steps, steps) + np.arange(ends[-1] if len(ends) else 0)]
        text_end = ends[words_end[lines_end - 1] + lines_end - 1].tolist()
        data = ids.tobytes()
        out = [data[a * width:b * width] for a, b in zip([0, *text_end], text_end)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.encode(column[i].as_py())
        return out

    @property
    def newline(self) -> bytes:
        if not hasattr(self, "_newline"):
            self._newline = self._pretokens("\n")
        return self._newline


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, ids): ids with the end id as little-endian 32-bit (or, for small vocabularies, 16-bit) numbers."""
    def run(batches: Iterator[pa.RecordBatch]):
        t = byte_level(path)
        width = array(t.kind).itemsize
        for b in slices(batches):
            data = t.encode_all(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d) // width for d in data], pa.int64()),
                                              pa.array([width] * len(data), pa.int32()), pa.array(data, pa.binary())],
                                             ["doc_id", "n", "width", "ids"])
    return texts(docs).mapInArrow(run, "doc_id bigint, n bigint, width int, ids binary")


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if width == 2 else np.uint32)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over the whole table; each task folds its own counts first."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(0, np.int64)
        for b in batches:
            for data, width in zip(b.column("ids").to_pylist(), b.column("width").to_pylist()):
                c = np.bincount(_numbers(data, width))
                if len(c) > len(total):
                    c[:len(total)] += total
                    total = c
                else:
                    total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])
    return tokens.select("ids", "width").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# --- the code ----------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64) if counts.sum() > 2 ** 62 else counts[order].astype(np.int64)
    levels, packages = [], leaves[:0]
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        is_leaf = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        at = np.argsort(weights, kind="stable")
        weights, is_leaf = weights[at], is_leaf[at]
        levels.append(is_leaf)
        even = len(weights) // 2 * 2
        packages = weights[:even:2] + weights[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of (ids, lengths): shorter first, then smaller id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        at = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[at].astype(np.int64), lengths[at].astype(np.int64)
        codes, code, last = np.zeros(len(at), np.int64), 0, 0
        first = np.searchsorted(self.lengths, np.arange(LIMIT + 2))
        for length in range(1, LIMIT + 1):
            code <<= 1
            n = first[length + 1] - first[length]
            codes[first[length]:first[length + 1]] = code + np.arange(n)
            code += int(n)
        top = int(self.ids.max()) + 1 if len(at) else 1
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = codes.astype(np.uint64), self.lengths
        self.table = None
        self._codes = codes

    def lookup(self) -> np.ndarray:
        """For every ``LIMIT`` bits: id * 64 + length of the code they begin with."""
        if self.table is None:
            self.table = np.zeros(1 << LIMIT, np.int64)
            span = 1 << (LIMIT - self.lengths)
            filled = np.repeat(self.ids * 64 + self.lengths, span)
            self.table[:len(filled)] = filled
        return self.table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of ``ids``, padded to whole bytes, and the bit offset of every ``BLOCK``-th id."""
        return self.encode_all(ids, np.array([len(ids)]))[0]

    def encode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """``encode`` of consecutive documents of ``counts`` ids each (one at least), in one pass."""
        codes, lengths = self.code_of[ids], self.length_of[ids]
        ends = np.cumsum(lengths)
        last = np.cumsum(counts) - 1
        sizes = np.diff(ends[last], prepend=0)
        begin = np.cumsum(-(-sizes // 64)) * 64 - -(-sizes // 64) * 64      # documents begin on whole words
        starts = ends - lengths + np.repeat(begin - (ends[last] - sizes), counts)
        word = starts >> 6
        room = 64 - (starts & 63) - lengths                             # below 0: the code runs into the next word
        over = np.flatnonzero(room < 0)
        high = codes << np.maximum(room, 0).astype(np.uint64)
        high[over] = codes[over] >> (-room[over]).astype(np.uint64)
        out = np.zeros(int(begin[-1] + sizes[-1] + 63 >> 6), np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))               # every word but perhaps a document's last has a start
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        data = out.astype(">u8").tobytes()
        found, at = [], 0
        for n, bit, size in zip(counts.tolist(), begin.tolist(), sizes.tolist()):
            found.append((data[bit >> 3:(bit >> 3) + (size + 7 >> 3)], starts[at:at + n:BLOCK] - bit))
            at += n
        return found

    def decode(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all blocks: block k has ``counts[k]`` ids from bit ``offsets[k]``.  One look-up serves a step of all blocks."""
        table = self.lookup()
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]      # 32 bits from each byte
        order = np.argsort(-counts, kind="stable")
        at, left = offsets[order].copy(), counts[order]
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
        out = np.zeros(int(counts.sum()), np.uint32)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))           # blocks with more than ``step`` ids
            pos = at[:live]
            hit = table[window[pos >> 3] >> (32 - LIMIT - (pos & 7)) & (1 << LIMIT) - 1]
            out[begin[:live] + step] = hit >> 6
            at[:live] += hit & 63
        return out


class Segment:
    """Binary layout, little-endian: ``THS1``, number of documents d (u4), number of blocks b (u4); d times doc_id (i8),
    present flag (u1), ids (u8), bytes (u8); b times bit offset in the document (u8); the documents' bits."""

    HEAD = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("n", "<u8"), ("size", "<u8")])

    @classmethod
    def pack(cls, docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
        """``docs``: doc_id, number of ids, checkpoints (u8), bits."""
        head = np.zeros(len(docs), cls.HEAD)
        for i, (doc_id, n, _, bits) in enumerate(docs):
            head[i] = (doc_id or 0, doc_id is not None, n, len(bits))
        marks = b"".join(d[2] for d in docs)
        counts = np.array([len(docs), len(marks) // 8], "<u4").tobytes()
        return b"".join([b"THS1", counts, head.tobytes(), marks, *(d[3] for d in docs)])

    @classmethod
    def unpack(cls, data: bytes, code: Code) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order."""
        if data[:4] != b"THS1":
            raise ValueError("not a token segment")
        n_docs, n_blocks = np.frombuffer(data, "<u4", 2, 4).tolist()
        head = np.frombuffer(data, cls.HEAD, n_docs, 12)
        at = 12 + head.nbytes
        marks = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
        bits = np.frombuffer(data, np.uint8, offset=at + marks.nbytes)
        n, size = head["n"].astype(np.int64), head["size"].astype(np.int64)
        blocks = -(-n // BLOCK)
        base = np.repeat((np.cumsum(size) - size) * 8, blocks)
        counts = np.full(n_blocks, BLOCK, np.int64)
        last = np.cumsum(blocks) - 1
        counts[last] = n - (blocks - 1) * BLOCK
        ids = code.decode(bits, marks + base, counts)
        ends = np.cumsum(n)
        for row, end, k in zip(head, ends.tolist(), n.tolist()):
            yield (int(row["doc_id"]) if row["present"] else None), ids[end - k:end]


# --- writing and reading -------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Write the coded ids of ``docs`` in ascending doc_id order and return the folder (``code`` and ``files`` in it).

    Null text counts as empty: its only id is the end id.  Null ids come first; repeated rows stay, equal doc_ids in
    the order of their bytes.  An empty table gives an empty folder that reads back as no rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/canonframe-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    raw = f"{path}/raw"
    tokenize(docs, tokenizer).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.parquet(raw)
    found = id_counts(tokens).toPandas().sort_values("id")          # at most one row per id of the vocabulary
    ids, counts = found["id"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths)], "id bigint, length bigint").coalesce(1).write.parquet(f"{path}/code")
    files = max(1, -(-int(counts.sum()) // FILE_IDS), spark.sparkContext.defaultParallelism)
    bounds = tokens.agg(F.percentile_approx("doc_id", [(i + 1) / files for i in range(files - 1)] or [0.5], 100 * files)).first()[0] or []
    bounds = np.unique(np.array(bounds if files > 1 else [], np.int64))
    shared = spark.sparkContext.broadcast((ids, lengths, bounds))   # vocabulary size and one number per file

    def run(batches: Iterator[pa.RecordBatch]):
        ids, lengths, bounds = shared.value
        code = Code(ids, lengths)
        for b in slices(batches, "ids"):
            widths = b.column("width").to_numpy()
            every = _numbers(b"".join(b.column("ids").to_pylist()), int(widths[0]))      # one vocabulary, one width
            coded = code.encode_all(every, b.column("n").to_numpy())
            bits = [c for c, _ in coded]
            marks = [starts.astype("<u8").tobytes() for _, starts in coded]
            doc_id = b.column("doc_id")
            file = np.searchsorted(bounds, doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), doc_id, b.column("n"), pa.array(marks, pa.binary()),
                                              pa.array(bits, pa.binary())], ["file", "doc_id", "n", "marks", "bits"])

    def pack(batches: Iterator[pa.RecordBatch]):
        held, ids_held, now, number = [], 0, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([number], pa.int64()),
                                               pa.array([sum(d[1] for d in held)], pa.int64()),
                                               pa.array([Segment.pack(held)], pa.binary())], ["file", "segment", "n", "data"])
        for b in slices(batches, "bits"):
            for file, *doc in zip(*(b.column(c).to_pylist() for c in ("file", "doc_id", "n", "marks", "bits"))):
                if held and (file != now or ids_held + doc[1] > SEGMENT):
                    yield row()
                    held, ids_held, number = [], 0, number + 1
                if file != now:
                    now, number = file, 0
                held.append(tuple(doc))
                ids_held += doc[1]
        if held:
            yield row()

    coded = tokens.mapInArrow(run, "file bigint, doc_id bigint, n bigint, marks binary, bits binary")
    ordered = coded.repartition(files, "file").sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "n", "bits")
    (ordered.mapInArrow(pack, "file bigint, segment bigint, n bigint, data binary")
     .write.option("compression", "uncompressed").parquet(f"{path}/files"))
    return path


def read_tokens(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files; ``start`` counts all ids before the document."""
    code = spark.read.parquet(f"{path}/code").toPandas()
    shared = spark.sparkContext.broadcast((code["id"].to_numpy(np.int64), code["length"].to_numpy(np.int64)))
    files = spark.read.parquet(f"{path}/files")
    within = W.partitionBy("file").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    heads = files.select("file", "segment", "n").withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = files.groupBy("file").agg(F.sum("n").alias("n"))
    totals = totals.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases = heads.join(totals, "file").select("file", "segment", (F.col("before") + F.col("base")).alias("base"))
    kinds = "file bigint, segment bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    kinds += "" if digest_only else ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]):
        code = Code(*shared.value)
        for b in slices(batches, "data"):
            for file, segment, data in zip(*(b.column(c).to_pylist() for c in ("file", "segment", "data"))):
                docs = list(Segment.unpack(data, code))
                n = np.array([len(i) for _, i in docs], np.int64)
                columns = [pa.array([file] * len(docs), pa.int64()), pa.array([segment] * len(docs), pa.int64()),
                           pa.array([d for d, _ in docs], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n),
                           pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, i in docs], pa.int64())]
                if not digest_only:
                    columns.append(pa.array([i.astype(np.int32) for _, i in docs], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [k.split()[0] for k in kinds.split(", ")])
    docs = files.select("file", "segment", "data").mapInArrow(run, kinds)
    return (docs.join(bases, ["file", "segment"])
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *([] if digest_only else ["ids"])))
