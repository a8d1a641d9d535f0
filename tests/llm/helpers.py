"""Small inputs every operator must stand: nulls, empty and long texts, repeated rows, further columns with clashing names."""

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [None, "", "   ", "one", "one two", "a b c d e f g h", "a b c d e f g h", "Ünïcode ▁ text\n\n  with\tspaces ", "x" * 5000, "word " * 20000,
             "the same line\n" * 50]


def odd_docs(spark, extra=True):
    """Documents of ODD_TEXTS, one of them twice, one without id; columns named as operators name their own."""
    rows = [(i, t, "score", 1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, n int, shard string")
    return docs if extra else docs.select("doc_id", "text")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
