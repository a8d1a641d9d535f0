"""Operator 9, SentencePiece encoding and decoding of merge-type (BPE) models.

Exact without a merge queue: from the left take the longest piece an Aho-Corasick automaton finds, keep it when it is
compatible with the piece before it (merging the two pieces' text afresh gives these two pieces again), else try its next
shorter prefix, else step back and mark the position as failed in a bit field, so that no position fails twice.

No piece of such a model holds a space mark after another character, so a text falls into independent segments (a run of
space marks and the characters up to the next), which are looked up in a bounded memo.  Characters no piece holds cut
segments and become byte pieces.  Null text is empty text; an empty text is the begin and end ids alone.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

SPACE = "▁"
MEMO = 200_000               # pairs a task remembers, and segments in each of two generations
_NEVER = float("inf")
MEMO_CHARS = 64              # longer segments are not remembered


def _packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder != "little":
        data.byteswap()
    return data.tobytes()


class Pieces:
    """The tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("only merge-type models without text normalisation are supported")
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.unk_surface = model.trainer_spec.unk_surface
        self.text = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        normal, byte = 1, 6
        if any(k in (4, 5) for k in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {p: -model.pieces[i].score for i, p in enumerate(self.text) if kinds[i] == normal}
        self.width = len(self.text)
        self.ids = {p: i for i, p in enumerate(self.text) if kinds[i] == normal}
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(kinds) if k == byte}
        self.is_byte = [k == byte for k in kinds]
        self.normal = [k == normal for k in kinds]
        self.surface = [bytes([int(p[3:5], 16)]) if k == byte else p.replace(SPACE, " ").encode() if k == normal
                        else self.unk_surface.encode() if k == 2 else b"" for p, k in zip(self.text, kinds)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        self.merges: dict[int, tuple] = {}
        for p, i in self.ids.items():
            if self.chars.issuperset(p):
                merges = self._remerge(p)
                if len(merges[0]) == 1:          # a piece that merging never reaches is never in a result
                    self.automaton.add_word(p, i)
                    self.merges[i] = merges
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}
        self.controls = [i for i, k in enumerate(kinds) if k == 3]
        self.lengths = [len(p) for p in self.text]

    def _remerge(self, text: str) -> tuple[list[str], list[int], list[str], list[str]]:
        """Merge a short text of known characters, best-ranked neighbours first, leftmost of equals.

        Gives the parts left, the rank of each merge in turn, and the first and last part before each and after all.
        """
        parts, rank = list(text), self.rank
        order, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], _NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            order.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return parts, order + [_NEVER], firsts, lasts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` together merges to these two pieces.

        The merges within each are replayed in the order in which one queue would take them; the pair is wrong as soon
        as a merge across the border would come before the next of these.
        """
        key = a * self.width + b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            _, left, _, lasts = self.merges[a]
            _, right, firsts, _ = self.merges[b]
            i = j = 0
            rank = self.rank
            while True:
                x, y = left[i], right[j]
                across = rank.get(lasts[i] + firsts[j], _NEVER)
                if across < x and across <= y and across < _NEVER:
                    known = False
                    break
                if x == y == _NEVER:
                    known = True
                    break
                if x <= y:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = known
        return known

    def shorter(self, piece: int) -> int:
        """The longest proper prefix that is a piece, or -1."""
        found = self._shorter.get(piece)
        if found is None:
            text = self.text[piece]
            found = next((self.automaton.get(text[:n]) for n in range(len(text) - 1, 0, -1) if self.automaton.exists(text[:n])), -1)
            self._shorter[piece] = found
        return found

    def _run(self, s: str) -> list[int]:
        """Pieces of a run of known characters."""
        lengths, automaton, pairs, width = self.lengths, self.automaton, self._pairs, self.width
        longest = {end + 1 - lengths[piece]: piece for end, piece in automaton.iter_long(s)}
        if len(longest) == 1 and lengths[longest[0]] == len(s):
            return [longest[0]]
        out: list[int] = []
        failed, at, n, token, before = 0, 0, len(s), longest[0], -1
        while True:
            while token >= 0:
                end = at + lengths[token]
                if not failed >> end & 1:
                    if before < 0:
                        break
                    fits = pairs.get(before * width + token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, before = end, token
                token = longest.get(at, -1)
                if token < 0:
                    token = longest[at] = next(automaton.iter_long(s, at))[1]
            else:
                failed |= 1 << at
                token = out.pop()
                at -= lengths[token]
                before = out[-1] if out else -1

    def segment(self, s: str) -> bytes:
        """Little-endian 32-bit ids of a segment."""
        chars = self.chars
        if chars.issuperset(s):
            return _packed(self._run(s)) if s else b""
        ids: list[int] = []
        start = 0
        for i, c in enumerate(s):
            if c not in chars:
                if i > start:
                    ids += self._run(s[start:i])
                start = i + 1
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]
        if start < len(s):
            ids += self._run(s[start:])
        return _packed(ids)

    def _spaced(self, word: str) -> bytes:
        """Ids of a space mark and ``word``; what the younger generation of the memo lacks may be in the older."""
        ids = self._old.get(word)
        if ids is None:
            ids = self.segment(SPACE + word)
        if len(word) <= MEMO_CHARS:
            if len(self._memo) >= MEMO:
                self._old, self._memo = self._memo, {}
            self._memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian 32-bit numbers."""
        out = [self.bos.to_bytes(4, "little")]
        if text:
            text = text.replace(SPACE, " ")      # both are the space mark
            known, missing = self._memo.get, self._spaced
            newline = None if "\n" in self.chars else self.segment("\n")
            for n, line in enumerate(text.split("\n") if newline else [text]):
                if n:
                    out.append(newline)
                if "  " in line or not n and line[:1] == " ":
                    for part in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", (SPACE if not n else "") + line.replace(" ", SPACE)):
                        out.append(self.segment(part))
                    continue
                words = line.split(" ")
                if n:                            # no space mark before the first word of a later line
                    first = self._bare.get(words[0])
                    if first is None:
                        if len(self._bare) >= MEMO // 4:
                            self._bare.clear()
                        first = self.segment(words[0])
                        if len(words[0]) <= MEMO_CHARS:
                            self._bare[words[0]] = first
                    out.append(first)
                    del words[0]
                ids = list(map(known, words))
                if None in ids:
                    ids = [missing(w) if i is None else i for w, i in zip(words, ids)]
                    known = self._memo.get       # it may have been renewed
                out += ids
        out.append(self.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: control pieces vanish, the first piece loses one space mark, wrong bytes become U+FFFD."""
        ids = list(ids)
        while ids and ids[0] in self.controls:
            del ids[0]
        while ids and ids[-1] in self.controls:
            del ids[-1]
        if any(c in ids for c in self.controls):     # they part byte pieces
            lead, out = ids[0], self._patched(ids)
            return out[1:] if self.normal[lead] and self.text[lead].startswith(SPACE) else out
        surface = self.surface
        lead = ids[0] if ids else None
        data = b"".join(map(surface.__getitem__, ids))
        try:
            out = data.decode("utf-8")
        except UnicodeDecodeError:
            out = self._patched(ids)
        return out[1:] if lead is not None and self.normal[lead] and self.text[lead].startswith(SPACE) else out

    def _patched(self, ids: list[int]) -> str:
        out, held = [], b""

        def flush(held):
            while held:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(held[:width].decode("utf-8"))
                        held = held[width:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    held = held[1:]
        for i in ids:
            if self.is_byte[i]:
                held += self.surface[i]
            else:
                flush(held)
                held = b""
                out.append(self.surface[i].decode("utf-8"))
        flush(held)
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): array of ids with begin and end, one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]):
        table = pieces(model)
        for b in slices(batches):
            data = [table.encode(t or "") for t in b.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(d) // 4 for d in data])
            ids = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])
    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]):
        table = pieces(model)
        for b in batches:
            out = [table.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode every text and decode its ids again, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]):
        table = pieces(model)
        for b in slices(batches):
            counts, coded, plain, kept = [], [], [], []
            for t in b.column("text").to_pylist():
                data = table.encode(t or "")
                ids = np.frombuffer(data, "<u4")
                counts.append(len(ids))
                coded.append(hashlib.sha256(data).hexdigest())
                plain.append(hashlib.sha256(table.decode(ids.tolist()).encode("utf-8")).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
