"""canonframe: DataFrame operators for addressed corpora on Apache Spark.

An addressed corpus is a set of texts, words, links and timed media whose rows
are keyed by a sparse, ordered, packed integer address.  Every operator takes
DataFrames and returns a DataFrame, so all of them can be chained with
``DataFrame.transform``.
"""

__version__ = "0.1.0"
