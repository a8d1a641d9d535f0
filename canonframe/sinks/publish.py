"""Fingerprints, staged builds with promotion, bounded exports, URL lists, review lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import gates as G


# --- fingerprint --------------------------------------------------------------------------------------

def row_digest(columns: list[str]) -> Column:
    """sha256 over length-prefixed fields, so no field can run into the next; NULL is not ''."""
    def field(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(text.isNull(), F.lit("-;")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


LEAF_ROWS = 4096       # rows of a leaf, on average, before the tree grows by a level


def fingerprint(df: DataFrame, columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row (n_rows, fingerprint): depends on the content only, not on order or partitioning.

    Equal rows are counted first, so they cannot pile up; digests are then
    folded as a tree over their own leading digits, two per level.  The number
    of leaves follows the number of rows, so no task gathers more than a leaf or
    256 folded digests.
    """
    fan_out, n = 2, df.count()
    while n > leaf_rows * 16 ** fan_out:
        fan_out += 2
    rows = df.select(row_digest(columns).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    level = rows.select(F.substring("d", 1, fan_out).alias("k"), F.concat("d", F.lit("*"), F.col("n").cast("string")).alias("v"), "n")

    def fold(frame: DataFrame, key: Column) -> DataFrame:
        return (frame.withColumn("_key", key).groupBy("_key").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("v")), ","), 256).alias("v"), F.sum("n").alias("n"))
            .select(F.col("_key").alias("k"), F.concat("_key", F.lit("="), "v").alias("v"), "n"))
    level = fold(level, F.col("k"))
    for digits in range(fan_out - 2, 0, -2):
        level = fold(level, F.substring("k", 1, digits))
    root = level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), ","), 256).alias("_f"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return root.select(F.col("n_rows").cast("bigint").alias("n_rows"), F.substring("_f", 1, 16).alias("fingerprint"))


# --- staged build ---------------------------------------------------------------------------------------

class GateFailure(RuntimeError):
    def __init__(self, violations: list[tuple[str, int]]):
        super().__init__("; ".join(f"{name}: {n}" for name, n in violations))
        self.violations = violations


class StagedBuild:
    """Write tables under a build id, check them, then swap one pointer file.

    Readers follow the pointer, so they see the old build or the new one and
    never a mixture; a failed gate leaves the pointer alone.
    """

    def __init__(self, spark: SparkSession, root: str, build_id: str):
        self.spark, self.root, self.build_id = spark, root.rstrip("/"), build_id

    def path(self, table: str, build_id: str | None = None) -> str:
        return f"{self.root}/builds/{build_id or self.build_id}/{table}"

    def write(self, table: str, df: DataFrame, partition_by: list[str] = (), sort_by: list[str] = ()) -> DataFrame:
        if sort_by:
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def promote(self, gates: list[G.Gate]) -> None:
        """Run the gates; publish only when all of them hold."""
        bad = [(r["gate"], r["violations"]) for r in G.failed(G.run(gates)).collect()]   # one row per gate
        if bad:
            raise GateFailure(bad)
        jvm, fs = self._fs()
        new = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT.{self.build_id}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"build_id": self.build_id}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT"), options)


def current_build(spark: SparkSession, root: str) -> str | None:
    """The published build id, or None before the first promotion."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/CURRENT")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root.rstrip('/')}/CURRENT", wholetext=True).first()[0])["build_id"]


# --- exports ------------------------------------------------------------------------------------------

EXPORT_CAP = 5_000     # fixed value: rows of one interactive export


def tsv_field(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]+", " ")


def bounded_export(df: DataFrame, columns: list[str], order: list, cap: int = EXPORT_CAP) -> DataFrame:
    """The first ``cap`` rows as tab-separated lines, with the true total and a truncation flag."""
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).limit(cap).select(F.concat_ws("\t", *[tsv_field(c) for c in columns]).alias("line"))
    return (rows.withColumn("total", total).withColumn("exported", F.least("total", F.lit(cap).cast("bigint")))
            .withColumn("truncated", F.col("total") > cap))


def write_urls(urls: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Sorted URL files of at most ``per_file`` lines per edition."""
    (urls.repartitionByRange("edition", "url").sortWithinPartitions("edition", "url")
     .write.partitionBy("edition").option("maxRecordsPerFile", per_file).text(path))


def url_list(available: DataFrame, base: str = "/read/") -> DataFrame:
    """Distinct collection, chapter and unit URLs per edition for what it really has."""
    book = F.expr("CAST(addr div 1000000 AS STRING)")
    chapter = F.expr("CAST((addr div 1000) % 1000 AS STRING)")
    unit = F.expr("CAST(addr % 1000 AS STRING)")
    urls = F.array(F.concat(F.lit(base), book), F.concat(F.lit(base), book, F.lit("."), chapter),
                   F.concat(F.lit(base), book, F.lit("."), chapter, F.lit("."), unit))
    return available.select("edition", F.explode(urls).alias("url")).distinct()


def review_lines(entities: DataFrame, citations: DataFrame, links: DataFrame) -> DataFrame:
    """One checklist text per unchecked entity: header, then its sources and verses, indented.

    ``entities``: event_id, title, status; ``citations``: event_id, ordinal, label; ``links``: event_id, start, end, link_type.
    """
    from ..operators.timeline import UNCHECKED, ordered_list
    todo = entities.where(F.col("status").isin(UNCHECKED))
    cited = citations.groupBy("event_id").agg(ordered_list([F.lit("  - Source: "), F.col("label")], [F.col("ordinal"), F.col("label")], "\n").alias("_c"))
    span = F.concat(F.col("start").cast("string"), F.when(F.col("end") != F.col("start"), F.concat(F.lit(" - "), F.col("end").cast("string"))).otherwise(""))
    verses = links.groupBy("event_id").agg(ordered_list([F.lit("  - Verse ("), F.col("link_type"), F.lit("): "), span],
                                                        [F.col("start"), F.col("end"), F.col("link_type")], "\n").alias("_v"))
    return (todo.join(cited, "event_id", "left").join(verses, "event_id", "left")
            .select("event_id", F.concat_ws("\n", F.concat(F.lit("- [ ] **"), "title", F.lit("** ("), "status", F.lit(")")), "_c", "_v").alias("sheet")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return G.run(list(tables.items())).select(F.col("gate").alias("table_name"), F.col("violations").alias("n_rows"))
