"""Ranked lexical search: BM25 in integers, answered by NRA.

NRA (no random access) reads the posting lists of a query from the largest
impact down and keeps for every document an interval: what it has collected so
far, and that plus the most the unread rest of its unseen lists can add.  It
goes on until no document that may still enter the answer has an open interval,
so membership, ties and the scores themselves are settled.

Statistics come from one pass over all documents, which also stores every
document's counts of the terms that some query asks for.  The stored rows are
then searched in bounded groups of documents (shards): each shard sorts its
own lists by impact and answers every query, and the answers are merged in two
steps.  A term that half of all documents hold is thereby spread over the
shards like any other.

Queries are taken in pieces of bounded size, the one thing sent to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import ship, written

TOP = 50
#: A piece of queries holds about this much text.
PIECE_BYTES = 8 << 20
#: A shard is closed at this many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: Postings of a list that the first round reads; each further round reads as many as all before.
FIRST_READ = 64
_SPREAD = 64
#: A-Z lower-cased, every other ASCII byte that is no letter or digit a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<long>"
_FOUND = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and anything beyond ASCII."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * n * N) div L of every length, without overflow."""
    own, at = np.unique(lengths, return_inverse=True)
    return np.array([50 + 50 * int(n) * n_docs // total for n in own], np.int64)[at]


def impacts(tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * norms)


class Shard:
    """Impact-sorted lists of a group of documents: list t holds the places
    ``docs[starts[t]:starts[t + 1]]``, largest impact first."""

    def __init__(self, doc_ids: np.ndarray, lists: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_lists: int) -> None:
        order = np.lexsort((docs, -impact, lists))
        self.doc_ids, self.docs, self.impact = doc_ids, docs[order], impact[order]
        self.starts = np.searchsorted(lists[order], np.arange(n_lists + 1))

    def nra(self, lists: list[int], weights: np.ndarray, top: int, first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``top`` documents with the highest scores
        above 0, equal scores by doc_id (nulls, the largest, last)."""
        low = np.zeros(len(self.doc_ids), np.int64)
        spans = [(int(self.starts[t]), int(self.starts[t + 1]), int(weights[t])) for t in lists
                 if self.starts[t] < self.starts[t + 1] and weights[t] > 0]
        read, depth = [0] * len(spans), first
        while True:
            fronts = np.zeros(len(spans), np.int64)      # the most the unread rest of a list holds
            for i, (a, b, w) in enumerate(spans):
                stop = min(b - a, depth)
                if stop > read[i]:
                    part = slice(a + read[i], a + stop)
                    low[self.docs[part]] += w * self.impact[part]
                    read[i] = stop
                fronts[i] = w * self.impact[a + stop] if a + stop < b else 0
            unseen = np.full(len(low), fronts.sum(), np.int64)
            for (a, _, _), r, front in zip(spans, read, fronts):
                if front:
                    unseen[self.docs[a:a + r]] -= front
            least = max(1, int(np.partition(low, -top)[-top])) if len(low) >= top else 1
            # an open interval that reaches the last place of the answer
            if not ((unseen > 0) & (low + unseen >= least)).any():
                break
            depth *= 2
        at = np.flatnonzero(low >= least)
        at = at[np.lexsort((self.doc_ids[at], -low[at]))][:top]
        return at, low[at]


def _counts(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = terms_of(text)
                if words:
                    found = Counter(map(vocabulary.get, words, repeat(-1)))
                    found.pop(-1, None)
                    ids.append(i)
                    lengths.append(len(words))
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


_NULL_ID = np.iinfo(np.int64).max


def _search(queries: list[list[int]], weights: np.ndarray, n_docs: int, total: int, top: int):
    def answers(ids: list, lengths: list, sizes: list, terms: list, tfs: list) -> pa.RecordBatch:
        sizes = np.concatenate(sizes)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        norms = length_norms(np.concatenate(lengths), n_docs, total)
        ids = pa.concat_arrays(ids)
        shard = Shard(ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False), np.concatenate(terms), docs,
                      impacts(np.concatenate(tfs), norms[docs]), len(weights))
        found = [(q, *shard.nra(lists, weights, top)) for q, lists in enumerate(queries)]
        at = np.concatenate([a for _, a, _ in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([q for q, _, _ in found], [len(a) for _, a, _ in found]), pa.int32()),
             ids.take(pa.array(at)), pa.array(np.concatenate([s for _, _, s in found]), pa.int64())],
            ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)[at:]
                # as many rows as the shard still takes, one at least
                fit = min(len(sizes), SHARD_DOCS - docs, 1 + int(np.searchsorted(np.cumsum(sizes), SHARD_POSTINGS - postings)))
                part = batch.slice(at, fit)
                held.append((part["doc_id"], part["n"].to_numpy(zero_copy_only=False), sizes[:fit],
                             part["terms"].flatten().to_numpy(zero_copy_only=False),
                             part["tfs"].flatten().to_numpy(zero_copy_only=False)))
                at, docs, postings = at + fit, docs + fit, postings + int(sizes[:fit].sum())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield answers(*zip(*held))
                    held, docs, postings = [], 0, 0
        if held:
            yield answers(*zip(*held))
    return run


def _pieces(items: DataFrame, piece_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries, piece by piece: (item_id, its terms, once each)."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-size // piece_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces))
    for piece in range(pieces):
        rows = sorted(((r["item_id"], r["text"]) for r in items.filter(of == piece).collect()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        asked = [(i, sorted(set(terms_of(t)))) for i, t in rows]
        if asked := [(i, t) for i, t in asked if t]:
            yield asked


def search(docs: DataFrame, items: DataFrame, top: int = TOP, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of every item's ``top`` highest-scoring
    documents with a score above 0, equal scores by doc_id, null ids last.

    Null and empty texts hold no term: such documents are in no answer and not
    counted, such items have none.  Repeated documents are documents each;
    repeated items are answered once; different texts under one item_id are
    searched each and ranked together.  Extra columns are ignored; an empty
    table gives no row.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text")
                    .filter("text IS NOT NULL").distinct(), "search-items")
    parts = []
    for piece in _pieces(asked, piece_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in piece for t in terms}))}
        counts = written(rows.mapInArrow(_counts(vocabulary), _COUNTS), "search-counts")
        n_docs, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = term_weight(n_docs, r["count"])
        found = counts.mapInArrow(
            _search([[vocabulary[t] for t in terms] for _, terms in piece], weights, n_docs, total, top), _FOUND)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(piece)], "query int, item_id long")
        parts.append(found.join(F.broadcast(names), "query").select("item_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", "part").orderBy(*best)
    found = (found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)))
             .withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top).drop("part"))
    return (found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
            .filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
