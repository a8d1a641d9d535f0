"""Operator 6, URL filters by a bit-parallel wildcard automaton.

All glob rules are packed one after the other into the bits of a few 64-bit words (Shift-And): bit ``p`` says that the
rule owning ``p`` has matched up to its element ``p``.  One step per character serves all rules and, as numpy arrays, all
URLs of a batch.  In a glob ``*`` stands for any run without ``/`` and ``**`` for any run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and the beginning of a path, as ``net/`` or ``example.net/en/``."""

    verdict: str
    text: str

    def globs(self) -> list[str]:
        """The rule as globs over canonical URLs (host, then path)."""
        host, slash, path = self.text.partition("/")
        return [f"{prefix}{_literal(host)}{_literal(slash + path)}**" for prefix in ("", "*.")]


def _literal(text: str) -> str:
    return re.sub(r"([*\\])", r"\\\1", text)


def _elements(glob: str) -> list[tuple[str, str]]:
    """(kind, character): literal ``c``, ``*`` or ``**``."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out.append(("c", glob[i + 1]))
            i += 2
        elif glob.startswith("**", i):
            out.append(("**", ""))
            i += 2
        elif glob[i] == "*":
            out.append(("*", ""))
            i += 1
        else:
            out.append(("c", glob[i]))
            i += 1
    return out


class Automaton:
    """Globs over the UTF-8 bytes of a text; ``match`` gives for each text which globs fit it whole.

    A literal byte is one bit.  A star is a mark on the bit before it: the bit may stay set while other bytes pass.  Each
    glob begins with a bit of its own that is set before the first byte.
    """

    def __init__(self, globs: list[str]):
        self.n = len(globs)
        bits: list[tuple[int, str]] = []           # (byte or -1 for the first bit, star after it)
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(bits))
            bits.append((-1, ""))
            for kind, c in _elements(glob):
                if kind == "c":
                    bits += [(b, "") for b in c.encode()]
                else:
                    star = "**" if "**" in (kind, bits[-1][1]) else "*"
                    bits[-1] = (bits[-1][0], star)
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.step = np.zeros((256, self.words), np.uint64)     # bits that a byte can set
        self.stay = np.zeros((256, self.words), np.uint64)     # bits that a byte leaves set
        for at, (byte, star) in enumerate(bits):
            word, bit = at >> 6, np.uint64(1 << (at & 63))
            if byte >= 0:
                self.step[byte, word] |= bit
            if star:
                self.stay[:, word] |= bit
                if star == "*":
                    self.stay[ord("/"), word] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for at in self.first:
            self.start[at >> 6] |= np.uint64(1 << (at & 63))

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (texts, globs)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (len(texts), 1))
        sorted_lengths = lengths[order]
        for i in range(int(sorted_lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-sorted_lengths, -i, "left"))
            byte = data[begin[:live] + i]
            now = state[:live]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = shifted & self.step[byte] | now & self.stay[byte]
        out = np.zeros((len(texts), self.n), bool)
        for g, at in enumerate(self.last):
            out[order, g] = state[:, at >> 6] >> np.uint64(at & 63) & np.uint64(1) != 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): A-Z of the host in lower case; both empty for null or a URL without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), slash + path


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row.

    The longest rule that fits wins; of equally long ones the one named first.  Without a fitting rule the rule is null
    and the verdict is ``allow``.  Null and unparsable URLs have an empty host and path and fit no rule.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    globs = [(g, n) for n, r in enumerate(ranked) for g in r.globs()]

    def run(batches: Iterator[pa.RecordBatch]):
        automaton = Automaton([g for g, _ in globs])
        owner = np.array([n for _, n in globs], np.int64)
        for b in slices(batches, "url"):
            parts = [canonical(u) for u in b.column("url").to_pylist()]
            fits = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            best = np.where(fits, owner, len(ranked)).min(axis=1, initial=len(ranked)).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([ranked[n].text if n < len(ranked) else None for n in best], pa.string()),
                 pa.array([ranked[n].verdict if n < len(ranked) else DEFAULT_VERDICT for n in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])
    return (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string"))
