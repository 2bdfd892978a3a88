"""SimHash near-duplicate groups through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed set of
reference fingerprints.  The references come as one base and, per 16-bit
block, sixteen more that differ from it by a Walsh pattern inside that block;
the difference of a reference's distance and the base's distance therefore
depends on that block only, and changes by at most the number of differing
bits in it.  Two fingerprints two bits apart agree in all coordinates of at
least two of the four blocks, so the coordinates of every pair of blocks serve
as candidate keys; candidates whose largest coordinate difference exceeds the
bit limit are discarded unseen, and the rest are verified bit by bit.

A key shared by more than ``bucket`` fingerprints is not compared pairwise: its
members go under each point one flip away (in the two other blocks), and those
that meet under one are the candidates.  Two fingerprints within two bits meet
so, at most 33 meet under a point, and no fingerprint has more than 2,080 others
within two bits, so neither candidates nor links grow faster than the members.
From there on all candidates are treated alike.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import attach, ship, words_of, written
from cohortlens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
BUCKET = 64
_SEED = 42
_CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; 0 without words."""
    w = words_of(text)
    if not w:
        return 0
    if len(w) < words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(words)))), len(w) - words + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, _SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_udf(words: int):
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))
    return of


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _walsh() -> list[int]:
    """Sixteen 16-bit patterns: all ones, and the other rows of the Walsh matrix."""
    rows = [0xFFFF]
    for r in range(1, 16):
        rows.append(sum(1 << i for i in range(16) if (r & i).bit_count() % 2))
    return rows


#: The reference fingerprints: the base, then sixteen per block.
REFERENCES = [_BASE] + [_BASE ^ (w << (16 * b)) for b in range(4) for w in _walsh()]
_BLOCK_PAIRS = list(combinations(range(4), 2))


def _distances(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("byte") for r in REFERENCES])


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, d): distances of each distinct fingerprint to every reference."""
    return fps.select("fp", _distances(F.col("fp")).alias("d"))


def _keys(table: DataFrame) -> DataFrame:
    """(kind, key, fp, d): the coordinates of each pair of blocks, hashed."""
    local = F.transform(F.slice("d", 2, 64), lambda x: (x - F.element_at("d", 1)).cast("byte"))
    key = [F.struct(F.lit(k).cast("byte").alias("kind"),
                    F.xxhash64(F.slice("local", 16 * a + 1, 16), F.slice("local", 16 * b + 1, 16)).alias("key"))
           for k, (a, b) in enumerate(_BLOCK_PAIRS)]
    return (table.withColumn("local", local).select("fp", "d", F.explode(F.array(*key)).alias("k"))
            .select("k.kind", "k.key", "fp", "d"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (``fp`` long, one row each)
    no more than ``max_bits`` (0 to 2) apart, each pair once, a < b."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two equal blocks of four are certain for at most 2 differing bits")
    keys = _keys(written(pivot_table(fps), "pivots"))
    shared = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keys.join(shared, ["kind", "key"]), "buckets")

    small = members.filter(F.col("n") <= bucket).select(F.struct("kind", "key").alias("at"), "fp", "d")
    free = F.lit(None).cast("array<bigint>")
    for k, (a, b) in enumerate(_BLOCK_PAIRS):
        flips = [1 << i for blk in range(4) if blk not in (a, b) for i in range(16 * blk, 16 * blk + 16)]
        free = F.when(F.col("kind") == k, F.array(*[F.lit(_signed(f)) for f in flips])).otherwise(free)
    points = F.concat(F.array(F.col("fp")), F.transform(free, lambda f: F.col("fp").bitwiseXOR(f)))
    large = members.filter(F.col("n") > bucket).select(F.explode(points).alias("at"), "fp", "d").dropDuplicates(["at", "fp"])
    return _verified(small, max_bits).unionByName(_verified(large, max_bits)).distinct()


def _verified(candidates: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) of the candidates (at, fp, d) that meet under one ``at``, less
    those whose distances to some reference differ too much, verified by bits."""
    x = candidates.select("at", F.col("fp").alias("a"), F.col("d").alias("da"))
    y = candidates.select("at", F.col("fp").alias("b"), F.col("d").alias("db"))
    apart = F.array_max(F.zip_with("da", "db", lambda p, q: F.abs(p - q)))
    return (x.join(y, "at").filter("a < b").filter(apart <= max_bits)
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
            .select("a", "b").distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
           max_bits: int = MAX_BITS) -> DataFrame:
    """One row (doc_id, text_hash, fp, component_id, label, links) per row of ``docs``.

    ``component_id`` is the least id reachable over links (itself included),
    ``label`` the least fingerprint of the component; ``links`` counts the other
    distinct fingerprints linked directly.  Null and empty texts have fingerprint
    zero and link like others; a null id links too but names a component only
    if all its ids are null (then null).  Repeated rows stay, extra columns
    are ignored, an empty table gives none.
    """
    ship(docs.sparkSession)
    fps = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                              _fingerprint_udf(words)(F.col(text_col)).alias("fp")), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    edges = written(links(classes.select("fp"), max_bits), "links")
    labels = written(components(edges), "labels")
    linked = written(classes.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "least"), "linked")
    named = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach(linked, written(named, "named"), "label", "n")
    degree = (edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp")))
              .groupBy("fp").agg(F.count(F.lit(1)).alias("links")))
    per_class = (classes.join(named.select("fp", "component_id", "label"), "fp", "left").join(degree, "fp", "left")
                 .select("fp", "n", F.coalesce("component_id", "least").alias("component_id"),
                         F.coalesce("label", "fp").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    return attach(fps, written(per_class, "classes"), "fp", "n")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with one per component: the one
    with the least doc_id (null last; ties by fingerprint and text, then any one
    row of the equal ones).  All columns stay.

    Which rows stay is decided on ids and hashes; whole rows pass one shuffle,
    by the key that both joins them to the decision and drops equal rows."""
    found = groups(docs, words=words, max_bits=max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash")).alias("first")
    kept = found.groupBy("label").agg(first).select(
        F.struct(F.col("first.doc_id"), F.col("first.text_hash")).alias("__kept"))
    kept = written(kept, "kept")
    rows = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    rows = rows.join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    return rows.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
