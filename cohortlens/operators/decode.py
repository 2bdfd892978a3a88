"""Decoding through a code-book table.

``functions.labels.decode_codes`` builds a CASE chain, right for the small
code books of a survey (a handful of codes).  A code book with thousands of
entries (diagnosis or drug codes) is better a table joined on the code.  The
code book is broadcast only after its row count is checked; above the limit
the join is left to a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code books up to this many rows are broadcast (code + label: a few MB).
BROADCAST_ROW_LIMIT = 200_000


def decode_with_table(df: DataFrame, code: str, codebook: DataFrame, book_code: str, book_label: str,
                      out: str) -> DataFrame:
    """``df`` plus column ``out``: the label of ``code`` in ``codebook``
    (NULL when the code is absent, like an unmatched CASE).  Codes must be
    unique in the code book; duplicates are rejected rather than silently
    multiplying rows."""
    book = codebook.select(F.col(book_code).alias("_code"), F.col(book_label).alias(out))
    stats = book.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_code").alias("d")).first()
    if stats.n != stats.d:
        raise ValueError(f"code book has duplicate codes in {book_code!r}")
    if stats.n <= BROADCAST_ROW_LIMIT:
        book = F.broadcast(book)
    return df.join(book, df[code] == book["_code"], "left").drop("_code")
