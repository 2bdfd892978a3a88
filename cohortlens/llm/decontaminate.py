"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The test items are indexed; every passage of every document, a window of
words that overlaps the next by half and is at least twice as long as any item
of its length class, is a query.  An item's BM25 score is divided by the score
it has with itself, so one threshold suits all: the share of an item's weight
that a passage covers.  Everything above it is retrieved, then verified on
word shingles: the shares of question and answer words that lie in a shingle
the passage has too.

The index is cut into pieces of bounded item text by a hash of the item, stored
as files in the shared scratch folder.  Documents are read once: a worker takes
a batch of them through all pieces, reading one piece, freeing it, and reading
the next, so it holds one at a time however many items there are.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import ship, store_of, written
from cohortlens.session import scratch_dir

THRESHOLD = 0.5
SHINGLE = 5
QUESTION_OVERLAP = 0.8
ANSWER_OVERLAP = 0.5
MIN_WINDOW = 128
BLOCK = 64
RANGE = 4
RANGE_CELLS = 1 << 23
PIECE_BYTES = 1 << 20
K1, B = 1.2, 0.75
_TOKEN = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SLACK = 1e-9


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def question_length(text: str) -> int:
    """Number of leading tokens that make up the question: all but the last
    line, or in a single line all but the last sentence; all if there is but one."""
    parts = [p for p in text.strip().split("\n") if tokens(p)]
    if len(parts) < 2:
        parts = [p for p in _SENTENCE.split(text.strip()) if tokens(p)]
    return sum(len(tokens(p)) for p in parts[:-1]) if len(parts) > 1 else len(tokens(text))


class Index:
    """Inverted index of one piece and length class, impacts scaled to the
    item's own score, postings in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float], mean_length: float,
                 threshold: float = THRESHOLD, block: int = BLOCK) -> None:
        self.threshold, self.block = threshold, block
        self.ids, self.tokens, self.asked = [], [], []
        postings: dict[str, list[tuple[int, float]]] = {}
        for ordinal, (item_id, text) in enumerate(sorted(items)):
            words = tokens(text)
            self.ids.append(item_id)
            self.tokens.append(words)
            self.asked.append(question_length(text))
            norm = K1 * (1 - B + B * len(words) / mean_length)
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            own = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            whole = sum(own.values())
            for w, x in own.items():
                postings.setdefault(w, []).append((ordinal, x / whole))
        # term 0 stands for every word without postings
        order = sorted(postings, key=lambda w: (-len(postings[w]), w))
        self.terms = {w: i for i, w in enumerate(order, 1)}
        self.items = [[]] + [[o for o, _ in postings[w]] for w in order]
        self.impacts = [[]] + [[x for _, x in postings[w]] for w in order]
        self.block_max = [[]] + [[max(p[i:i + block]) for i in range(0, len(p), block)] for p in self.impacts[1:]]
        self.most = np.array([0.0] + [max(p) for p in self.impacts[1:]])
        # Bounds of ranges of neighbouring items: what a term adds to any of
        # them at most.  As many ranges as keep the table small.
        n_ranges = max(1, min(-(-len(self.ids) // RANGE), RANGE_CELLS // len(self.items)))
        self.width = -(-len(self.ids) // n_ranges)
        self.range_max = np.zeros((len(self.items), -(-len(self.ids) // self.width)), np.float32)
        for t in range(1, len(self.items)):
            np.maximum.at(self.range_max[t], np.array(self.items[t]) // self.width, self.impacts[t])
        longest = max([1, *map(len, self.tokens)])
        self.window = max(MIN_WINDOW, 1 << (2 * longest - 1).bit_length())

    def live(self, terms: np.ndarray) -> list[int]:
        """Ranges of items that may hold one above the threshold."""
        return np.flatnonzero(self.range_max[terms].sum(axis=0) >= self.threshold - 1e-4).tolist()

    def search(self, terms: list[int], low: int = 0, high: int = 1 << 60) -> list[tuple[int, float]]:
        """(item ordinal, score) of every item from ``low`` to before ``high``
        that scores the threshold or more for a set of terms: block-max WAND."""
        need = self.threshold - _SLACK
        items, impacts, block_max, most, size = self.items, self.impacts, self.block_max, self.most, self.block
        starts = [(t, bisect_left(items[t], low)) for t in terms]
        cursors = [[items[t][i], t, i] for t, i in starts if i < len(items[t]) and items[t][i] < high]   # item, term, place
        found = []

        def to(cursor: list, item: int) -> bool:
            p = items[cursor[1]]
            cursor[2] = bisect_left(p, item, cursor[2])
            if cursor[2] == len(p) or p[cursor[2]] >= high:
                return False
            cursor[0] = p[cursor[2]]
            return True

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += most[c[1]]
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, 1 << 60
            for c in cursors[:pivot + 1]:
                p = items[c[1]]
                at = bisect_left(p, item, c[2])
                if at < len(p):
                    b = at // size
                    bound += block_max[c[1]][b]
                    until = min(until, p[min(len(p), (b + 1) * size) - 1] + 1)
            if bound < need:     # nothing in these blocks: past the first to end, or to the next cursor
                if pivot + 1 < len(cursors):
                    until = min(until, cursors[pivot + 1][0])
                target, moved = max(until, item + 1), pivot + 1
            elif cursors[0][0] == item:
                score = sum(impacts[c[1]][c[2]] for c in cursors[:pivot + 1])
                if score >= need:
                    found.append((item, score))
                target, moved = item + 1, pivot + 1
            else:
                target = item
                moved = next(i for i, c in enumerate(cursors) if c[0] >= item)
            cursors = [c for i, c in enumerate(cursors) if i >= moved or to(c, target)]
        return found

    def overlaps(self, ordinal: int, words: list[str]) -> tuple[float, float]:
        """Shares of the item's question and answer words that lie in a shingle
        which ``words`` has; 1 for a part without words."""
        own = self.tokens[ordinal]
        k = min(SHINGLE, len(own))
        there = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
        covered = np.zeros(len(own), bool)
        for i in range(len(own) - k + 1):
            if tuple(own[i:i + k]) in there:
                covered[i:i + k] = True
        q = self.asked[ordinal]
        return tuple(float(c.mean()) if len(c) else 1.0 for c in (covered[:q], covered[q:]))

    def hits(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """item id -> (score, question and answer overlap) of its best verified passage."""
        words = tokens(text)
        n, out = len(words), {}
        if not n:
            return out
        terms = np.fromiter(map(self.terms.get, words, repeat(0)), np.int32, n)
        step = self.window // 2
        for s in range(0, max(1, n - step), step):
            asked = np.unique(terms[s:s + self.window])
            passage, known = None, None
            for r in self.live(asked):
                known = known or [t for t in asked.tolist() if t]
                for ordinal, score in self.search(known, r * self.width, (r + 1) * self.width):
                    passage = passage or words[s:s + self.window]
                    q, a = self.overlaps(ordinal, passage)
                    if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                        item = self.ids[ordinal]
                        out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, set(w), len(w)) for i, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist())
                 if (w := tokens(t))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in found], pa.int64()), pa.array([sorted(w) for _, w, _ in found], pa.list_(pa.string())),
             pa.array([n for _, _, n in found], pa.int64())], ["item_id", "terms", "length"])


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, piece_bytes: int = PIECE_BYTES) -> Iterator[list[Index]]:
    """The index, piece by piece; each piece holds about ``piece_bytes`` of
    item text and is a list of one Index per length class.

    Statistics are over all items.  Items without a word, or with a null id,
    can't be retrieved; of several texts under one id each is an item."""
    ship(benchmark.sparkSession)
    items = written(benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL")
                    .select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
    seen = written(items.mapInArrow(_statistics, "item_id long, terms array<string>, length long"), "item_terms")
    n, mean, size = seen.agg(F.count(F.lit(1)), F.avg("length"), F.lit(0)).first()
    if not n:
        return
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    pieces = max(1, -(-size // piece_bytes))
    df = written(seen.select(F.explode("terms").alias("term")).groupBy("term").count(), "frequencies")
    piece_of = F.pmod(F.xxhash64("item_id"), F.lit(pieces))
    for piece in range(pieces):
        mine = items.filter(piece_of == piece)
        terms = seen.filter(piece_of == piece).select(F.explode("terms").alias("term")).distinct()
        idf = {r["term"]: math.log(1 + (n - r["count"] + 0.5) / (r["count"] + 0.5)) for r in df.join(terms, "term").collect()}
        classes: dict[int, list] = {}
        for r in mine.collect():
            if w := tokens(r["text"]):
                classes.setdefault(max(MIN_WINDOW // 2, 1 << (len(w) - 1).bit_length()), []).append((r["item_id"], r["text"]))
        if classes:
            yield [Index(c, idf, mean, threshold) for _, c in sorted(classes.items())]


def stored(spark: SparkSession, found: Iterator[list[Index]]) -> list[str]:
    """The pieces as files in the shared scratch folder, made one at a time."""
    folder, paths = scratch_dir(spark, "llm", "pieces"), []
    for index in found:
        paths.append(f"{folder}/{len(paths)}")
        store, at = store_of(paths[-1])
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at, compression="zstd") as f:
            f.write(pickle.dumps(index))
        del index
    return paths


class Pieces:
    """Stored pieces, read one after another by a worker."""

    def __init__(self, paths: list[str]) -> None:
        self.paths, self.path, self.index = paths, None, []

    def through(self, texts: list) -> Iterator[tuple[int, dict]]:
        """(place of the text, hits) for every piece and text.  Passes go to and
        fro, so the piece that ends one is at hand for the next."""
        for path in self.paths if self.path != self.paths[-1] else self.paths[::-1]:
            if path != self.path:
                self.index = []      # freed before the next is read
                store, at = store_of(path)
                with store.open_input_stream(at, compression="zstd") as f:
                    self.index, self.path = pickle.loads(f.read()), path
            for i, text in enumerate(texts):
                for one in self.index:
                    yield i, one.hits(text)


def _search(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(paths)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[i], item, *best) for i, hits in pieces.through(batch["text"].to_pylist())
                    for item, best in hits.items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


_HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every
    document with a passage that holds a test item, from its best passage.

    Null and empty texts hold none; a null doc_id is reported as null; repeated
    rows are each reported; extra columns are ignored; an empty benchmark or
    table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paths = stored(rows.sparkSession, indexes(benchmark, **options))
    return rows.mapInArrow(_search(paths), _HITS) if paths else rows.sparkSession.createDataFrame([], _HITS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a passage that holds a test item, all columns.

    Null and empty texts stay, as do null ids and repeated rows of clean texts;
    an empty benchmark keeps every row, an empty table gives none."""
    paths = stored(docs.sparkSession, indexes(benchmark, **options))
    return docs.filter(_clean(paths)(F.col("text"))) if paths else docs


def _clean(paths: list[str]):
    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(paths)
        for texts in batches:
            clean = np.ones(len(texts), bool)
            for i, hits in pieces.through(texts.tolist()):
                clean[i] &= not hits
            yield pd.Series(clean)
    return of
