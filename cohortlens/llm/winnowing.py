"""Winnowed document fingerprints.

The k-gram hashes of a text (code points, polynomial, from running sums) are
mixed; of every window of ``w`` consecutive k-grams the least is selected, the
rightmost on ties.  A selected hash is kept once per position, so any two
texts that share w + k - 1 code points share a selected hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from hashlib import sha256
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ship, written

K = 16
WINDOW = 32
_CHUNK = 1 << 18
_R = 0x9E3779B97F4A7C15      # odd, so it has an inverse modulo 2^64
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_R, _CHUNK + 1)
_DOWN = _powers(pow(_R, -1, 1 << 64), _CHUNK + 1)


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams of at most ``_CHUNK`` code points: sums of
    code times R^i, shifted back to power zero and mixed."""
    n = len(codes)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=run[1:])
    h = (run[k:] - run[:-k]) * _DOWN[:n - k + 1]
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h >> np.uint64(32)


def winnow(text: str | None, k: int = K, w: int = WINDOW) -> np.ndarray:
    """Selected k-grams as hash << 32 | (2^32 - 1 - position), by position.

    A text shorter than k is one k-gram of its own length; null and empty
    texts have no fingerprint.  Fewer than w k-grams make one window.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    w = min(w, n - k + 1)
    step, out = _CHUNK - (w + k - 2), []
    for at in range(0, n - k - w + 2, step):
        h = kgram_hashes(codes[at:at + _CHUNK], k)
        keys = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF - at) - np.arange(len(h), dtype=np.uint64))
        span = 1
        while 2 * span <= w:         # least of windows of 2, 4, ... k-grams
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < w:
            keys = np.minimum(keys[:len(keys) - (w - span)], keys[w - span:])
        keep = np.ones(len(keys), bool)
        keep[1:] = keys[1:] != keys[:-1]
        if out and keys[0] == out[-1][-1]:
            keep[0] = False
        out.append(keys[keep])
    return np.concatenate([x for x in out if len(x)])


def hashes(selected: np.ndarray) -> np.ndarray:
    return selected >> np.uint64(32)


def positions(selected: np.ndarray) -> np.ndarray:
    return np.uint64(0xFFFFFFFF) - (selected & np.uint64(0xFFFFFFFF))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) per row of ``docs``: its selected k-grams
    in order.  Null and empty texts have empty lists; extra columns are
    ignored; repeated rows stay; an empty table gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [winnow(t, k, w) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([hashes(x).astype(np.int64) for x in found], pa.list_(pa.int64())),
                     pa.array([positions(x).astype(np.int64) for x in found], pa.list_(pa.int64()))],
                    ["doc_id", "hashes", "positions"])
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, hashes array<long>, positions array<long>")


def _digest(selected: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(selected.tobytes())


class _Printed:
    """A document with its fingerprint, worked out once."""

    def __init__(self, doc_id, text, k: int, w: int) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.selected = winnow(text, k, w)
        self.set = np.unique(hashes(self.selected))

    def against(self, after: "_Printed", k: int, w: int) -> tuple:
        half = len(self.text) // 2
        edited = self.text[:len(self.text) - half] + after.text[:half]
        print_ = winnow(edited, k, w)
        return (self.doc_id, len(self.text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                _digest(self.selected), _digest(print_), likeness(self.set, np.unique(hashes(print_))),
                likeness(self.set, after.set))


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
           ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
           ("near_next", pa.float64())]
_RESULT = pa.schema(_FIELDS + [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double, part int, edge string, text string")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r)) for r in found], _RESULT)


def edit_likeness(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each document, of its edited text (the second half, cut
    at floor(n / 2) code points, replaced by as many first ones of the next
    document) and their likeness, also to the next document's.

    The next document is the one with the next smaller doc_id (null last, equal
    ids in order of text), the last one's the first.  Documents are dealt out
    once by ranges of the id and read in order in each part; the first and last
    document of every part are joined afterwards.  Null texts count as empty; a
    single document is its own next; an empty table gives none.
    """
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, none = TaskContext.get().partitionId(), None, (None,) * 7
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece, out = batch.slice(at, 512), []
                for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist()):
                    doc = _Printed(doc_id, text, k, w)
                    if last is None:
                        out.append((doc_id, *none[1:], part, "first", doc.text))
                    else:
                        out.append((*last.against(doc, k, w), part, None, None))
                    last = doc
                yield _rows(out)
        if last is not None:
            yield _rows([(last.doc_id, *none[1:], part, "last", last.text)])

    done = written(ranged.mapInArrow(inside, _RESULT_DDL), "winnowed")
    used = sorted(r["part"] for r in done.filter("edge = 'first'").select("part").collect())
    after = docs.sparkSession.createDataFrame(
        [(p, used[(i + 1) % len(used)]) for i, p in enumerate(used)], "part int, next_part int")
    firsts = done.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    edges = (done.filter("edge = 'last'").select("doc_id", "text", "part").join(after, "part")
             .join(firsts, "next_part").select("doc_id", "text", "next_text"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(*_Printed(r["doc_id"], r["text"], k, w).against(_Printed(None, r["next_text"], k, w), k, w),
                          None, None, None) for r in batch.to_pylist()])

    names = [n for n, _ in _FIELDS]
    return done.filter("edge IS NULL").select(*names).unionByName(edges.mapInArrow(across, _RESULT_DDL).select(*names))
