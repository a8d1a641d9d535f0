"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns, whatever their names, neither travel nor clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``most`` bytes of text (one row at least): bounds what Python holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text_col)
        import pyarrow.compute as pc
        ends = np.cumsum(pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A fixed 64-bit mixing function (multiply and shift) of unsigned numbers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large and small stars: each round is two grouped minima joined back, so a hub is folded map-side
    and split by the adaptive skew join.  Every round is written to the shared folder; only a row count and a checksum
    reach the driver.  Empty input gives an empty table.
    """
    edges = cut_lineage(edges.where("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def signature(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()

    last = signature(edges)
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = cut_lineage(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                            .select("e.a", "e.b").where("a <> b").distinct())
        now = signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# ASCII characters that are neither letters, digits nor apostrophes part words.
_PARTING = bytes(32 if b < 128 and not (chr(b).isalnum() or b == 39) else b for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words of a whole text in UTF-8: ASCII lower case, parted by ASCII punctuation and white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTING).split()


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, where: str = "true") -> DataFrame:
    """(doc_id, text, y): a bounded sample of labelled rows, at most ``most`` of each class.

    The rows with the smallest hash of doc_id are taken, so the sample is the same in every run.  It is chosen on the
    labels alone, before any text is read.  Ids with contradicting labels are left out.
    """
    y = F.col(label).cast("int")
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), y.alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(where).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z"))
    taken = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        taken = part if taken is None else taken.unionByName(part)
    return texts(docs).join(taken, "doc_id")
