"""Vector code compression by exact integer distances.

A vector is cut into parts, each replaced by the index of the nearest entry of
that part's codebook.  Components become integers, so distances are exact and a
tie is a tie.  Dot products still go through float64 BLAS: integers are split
into limbs so short that no sum of limb products reaches 2^53, the products
are exact, and the dot products are put together again in int64 (in Python
integers where int64 could overflow).

Every round is one pass over all vectors.  A task returns one row per codebook
component, its sums split into limbs too, so that Spark adds them up in longs
whatever their size.  Only the codebooks, of fixed size, pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import attach, ship, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Sums travel as signed limbs of this many bits, enough of them for any
#: float32 component of 2^24 rows in a task.
SUM_BITS, SUM_LIMBS = 40, 5
_ROWS = 4096
_LONG = 1 << 63
_SUMS = "part int, entry int, position int, n long, " + ", ".join(f"s{i} long" for i in range(SUM_LIMBS))
_CODED = "vec_id long, label_key string, code string, error long"


def top(a: np.ndarray) -> int:
    """Largest absolute value, as a Python integer."""
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, lowest first, whose absolute values stay
    within 2^bits: ``a`` is the sum of limb i times 2^(bits * i)."""
    count = max(1, -(-top(a).bit_length() // bits))
    low, out = a, []
    for _ in range(count - 1):
        out.append((low & ((1 << bits) - 1)).astype(np.float64))
        low = low >> bits
    return out + [low.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact."""
    inner = max(1, a.shape[1])
    bits = (53 - (inner - 1).bit_length()) // 2 - 1
    wide = inner * top(a) * top(b) >= _LONG
    out = np.zeros((len(a), len(b)), object if wide else np.int64)
    left, right = limbs(a, bits), limbs(b, bits)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            product = (x @ y.T).astype(np.int64)
            out += (product.astype(object) if wide else product) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` the index of the nearest row of ``book``, ties to
    the lower, and the squared distance."""
    most = max(1, x.shape[1]) * (top(x) + top(book)) ** 2
    if most >= _LONG:
        x, book = x.astype(object), book.astype(object)
    own, norms = (x * x).sum(axis=1), (book * book).sum(axis=1)
    rest = norms[None, :] - 2 * exact_dot(x, book)
    at = rest.argmin(axis=1)
    return at, own + rest[np.arange(len(x)), at]


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exact for finite x and a scale that is a power of two."""
    if not x.size or np.abs(x).max() * scale < 2.0 ** 52:
        return np.floor(x * scale).astype(np.int64)
    flat = [int(np.floor(v * scale)) if abs(v) < 2.0 ** 52 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


class Codebooks:
    """Entries of every part position: integers [parts][entries][width]."""

    def __init__(self, vectors: list[list[float]], parts: int, scale: int) -> None:
        self.length, self.parts, self.scale = len(vectors[0]), parts, scale
        self.width = -(-self.length // parts)
        whole = self.cut(np.array(vectors, np.float64).reshape(len(vectors), self.length))
        self.books = [whole[:, p, :] for p in range(parts)]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Float rows as integers by part, the last part filled up with zeros."""
        x = integers(np.pad(x, ((0, 0), (0, self.width * self.parts - self.length))), self.scale)
        return x.reshape(len(x), self.parts, self.width)

    def digest(self) -> str:
        text = ",".join(str(int(v)) for book in self.books for v in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


def _matrix(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``length`` components, and those rows as float64."""
    vectors = batch["vector"]
    fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == length
    rows = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return fits, rows.reshape(int(fits.sum()), length)


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        sums = [np.zeros(b.shape, object) for b in books.books]
        for batch in batches:
            _, rows = _matrix(batch, books.length)
            for s in range(0, len(rows), _ROWS):
                x = books.cut(rows[s:s + _ROWS])
                for p, book in enumerate(books.books):
                    at, _ = nearest(x[:, p], book)
                    counts[p] += np.bincount(at, minlength=len(book))
                    if x.dtype == object or top(x) * _ROWS >= _LONG:
                        np.add.at(sums[p], at, x[:, p].astype(object))
                    else:
                        part = np.zeros(book.shape, np.int64)
                        np.add.at(part, at, x[:, p])
                        sums[p] += part.astype(object)
        rows = []
        for p, (n, total) in enumerate(zip(counts, sums)):
            for e in np.flatnonzero(n):
                for i, v in enumerate(total[e]):
                    v, own = int(v), []
                    for _ in range(SUM_LIMBS - 1):
                        own.append(v & ((1 << SUM_BITS) - 1))
                        v >>= SUM_BITS
                    rows.append((p, int(e), i, int(n[e]), *own, v))
        cols = list(zip(*rows)) or [[]] * (4 + SUM_LIMBS)
        kinds = [pa.int32()] * 3 + [pa.int64()] * (1 + SUM_LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["part", "entry", "position", "n", *(f"s{i}" for i in range(SUM_LIMBS))])
    return run


def _refined(rows: DataFrame, books: Codebooks) -> None:
    """One round: every entry becomes the floored mean of its parts."""
    found = rows.mapInArrow(_sums(books), _SUMS).groupBy("part", "entry", "position").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUM_LIMBS)])
    moved = [b.astype(object) for b in books.books]
    for r in found.collect():      # parts x entries x width rows at most
        moved[r["part"]][r["entry"], r["position"]] = sum(r[f"s{i}"] << (SUM_BITS * i) for i in range(SUM_LIMBS)) // r["n"]
    books.books = [b if top(b) >= 1 << 62 else b.astype(np.int64) for b in moved]


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, rows = _matrix(batch, books.length)
            codes, errors = [], []
            for s in range(0, len(rows), _ROWS):
                x = books.cut(rows[s:s + _ROWS])
                found = [nearest(x[:, p], book) for p, book in enumerate(books.books)]
                index = np.stack([at for at, _ in found], axis=1)
                wide = "".join(f"{v:0{_digits(books)}x}" for v in index.ravel())
                step = _digits(books) * books.parts
                codes += [wide[i:i + step] for i in range(0, len(wide), step)]
                errors += [e if e < _LONG else None for e in map(int, sum(d.astype(object) for _, d in found))]
            code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits], error[fits] = codes, errors
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label_key"], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label_key", "code", "error"])
    return run


def _digits(books: Codebooks) -> int:
    """Hex digits of an index: two, or more for codebooks of over 256 entries."""
    return max(2, ((len(books.books[0]) - 1).bit_length() + 3) // 4)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector
    that is not null and holds neither nulls nor non-finite components.

    Vectors have the length of the first (least vec_id); parts are filled up
    with zeros where the length is no multiple of ``parts``.  A vector of
    another length has a null code and error, and no say in the codebooks.  An
    error beyond a long is null.  ``label_error`` sums the errors there are
    over equal labels, null labels together; null if it is beyond a long.
    Null vec_ids come last when the codebooks are started, rows of one vec_id
    in the order of their components; repeated rows count each; extra columns
    are ignored; no usable vector gives no row.
    """
    spark = vectors.sparkSession
    ship(spark)
    # the key says null or not, so that null labels meet each other only
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
        F.when(label.isNull(), "n").otherwise(F.concat(F.lit("v"), label.cast("string"))).alias("label_key"),
    ).filter(usable(F.col("vector")))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    start = [r["vector"] for r in first if len(r["vector"]) == len(first[0]["vector"])]
    if len(start) < len(first):
        start = [r["vector"] for r in rows.filter(F.size("vector") == len(first[0]["vector"]))
                 .orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    books = Codebooks(start, parts, scale)
    for _ in range(rounds):
        _refined(rows, books)
    coded = written(rows.mapInArrow(_coded(books), _CODED), "vector-codes")
    sums = written(coded.groupBy("label_key").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)).alias("total"))
        .select("label_key", "rows", F.expr("try_cast(total AS long)").alias("label_error")), "label-errors")
    return attach(coded, sums, "label_key", "rows").select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
