"""SQL-callable table functions for interactive use; the column jobs are the default path."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_FULL = re.compile(r"^\s*(.*?[A-Za-z].*?)\s+(\d+)\s*:\s*(\d+)(?:\s*[-–—]\s*(\d+))?\s*$")
_BARE = re.compile(r"^(\d+)(?:\s*[-–—]\s*(\d+))?$")

SCHEMA = StructType([StructField("item", LongType()), StructField("raw", StringType()), StructField("book_name", StringType()),
                     StructField("chapter", LongType()), StructField("first_unit", LongType()), StructField("last_unit", LongType())])


class SplitReferences:
    """``Name 3:16, 18-20; Name 8`` -> one row per part, bare numbers with the name and chapter before them."""

    def eval(self, text: str):
        name = chapter = None
        for item, part in enumerate(re.split("[;,]", text or "")):
            raw = part.strip()
            if not raw:
                continue
            bare, full = _BARE.match(raw), _FULL.match(raw)
            if bare and name is not None:
                first = int(bare[1])
                yield item, raw, name, chapter, first, int(bare[2] or first)
            elif full:
                name, chapter = full[1], int(full[2])
                yield item, raw, name, chapter, int(full[3]), int(full[4] or full[3])
            else:
                name = chapter = None
                yield item, raw, raw, None, None, None


def register(spark: SparkSession, name: str = "split_references") -> None:
    spark.udtf.register(name, F.udtf(SplitReferences, returnType=SCHEMA))
