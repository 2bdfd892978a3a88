"""Katz back-off language model, trained on and applied to a whole corpus.

Bigram counts up to ``K`` are discounted by Good-Turing estimates; the mass
this frees in a context goes to the words not seen there, in proportion to the
discounted unigram model, by a weight that makes every context sum to one.
Unigram mass goes to the one event "unknown word".

Documents are tokenised once, into blocks stored bucketed by block id: a
dictionary of word hashes and a stream of positions in it.  Counts live in
tables partitioned by a hash of the word (unigrams) or of the context
(bigrams).  A block asks a partition with the sorted, locally counted items it
holds of it; the partition adds up what all blocks sent and answers every block
in the block's own order, so neither documents nor tables travel.  A context
with many occurrences is salted by the following word, and a block that
meets it hears all its salts.

Counts for which Good-Turing gives no proper discount (too little data) are
discounted by 1 - 1 / 2r.  A context whose counts are all above K has no freed
mass: one unseen event is added to its total.

Words are known by 64-bit hashes, followers of a context by 48 bits of them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ship, words_of, written
from cohortlens.session import scratch_dir

K = 5
BLOCK_TOKENS = 1_000_000
PART_ITEMS = 500_000
SALT_TOKENS = 4_000_000
FOLDS, HELD_OUT = 7, 2
#: No word contains a space.
_END, _START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


# ---- small encodings ----------------------------------------------------------

def _planes(x) -> bytes:
    """Unsigned integers byte plane by byte plane, as many as the largest needs,
    packed: counts are mostly small, which the shuffle's own codec leaves
    unused, as it codes repeats only."""
    x = np.ascontiguousarray(x, np.uint64)
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())


def _from_planes(b: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``_planes``."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view(np.int64).ravel()


def _u64(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _cut(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that sorts by part, and (part, from, to) of each part in it."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))


# ---- discounts ----------------------------------------------------------------

def discounts(count_of_counts: list[int], k: int = K) -> np.ndarray:
    """Katz discounts d[0..k] (d[0] unused) from the numbers of items seen
    1, 2, ... k + 1 times."""
    n = [0, *count_of_counts]
    for top in range(k, 0, -1):
        if any(n[r] == 0 for r in range(1, top + 2)):
            continue
        share = (top + 1) * n[top + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if share != 1 else 0 for r in range(1, top + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d, *(1 - 0.5 / r for r in range(top + 1, k + 1))])
    return np.array([1.0, *(1 - 0.5 / r for r in range(1, k + 1))])


class Unigrams:
    """The discounted unigram model: counts -> probabilities; 0: the unknown word."""

    def __init__(self, total: int, types: int, count_of_counts: list[int], k: int = K) -> None:
        self.total, self.types, self.k = total, types, k
        self.d = discounts(count_of_counts, k)
        freed = sum((1 - self.d[r]) * r * n for r, n in enumerate(count_of_counts[:k], 1))
        self.room = 0.0 if freed > 0 else 1.0      # the added unseen event
        self.unknown = (freed + self.room) / (total + self.room)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= self.k, self.d[np.minimum(counts, self.k)], 1.0)
        return np.where(counts > 0, d * counts / (self.total + self.room), self.unknown)


# ---- blocks -------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("stream", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.binary()), ("train", pa.binary())])
_BLOCK_DDL = "block long, words binary, stream binary, doc_ids array<long>, lengths binary, train binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def empty():
        return {}, [], [], [], 0

    def out():
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        # the end of a text is the dictionary's last entry
        words = np.append(words, _END)
        stream = np.concatenate([np.append(x, len(index)) for x in streams]).astype(np.uint32)
        return pa.RecordBatch.from_pydict({
            "block": [uuid.uuid4().int >> 65], "words": [words.tobytes()], "stream": [stream.tobytes()],
            "doc_ids": [ids], "lengths": [np.array([len(x) + 1 for x in streams], np.uint32).tobytes()],
            "train": [np.array(train, np.uint8).tobytes()]}, _BLOCK)

    index, streams, ids, train, size = empty()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                words = words_of(text)
                streams.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words)))
                ids.append(doc_id)
                train.append(doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield out()
                    index, streams, ids, train, size = empty()
    if ids:
        yield out()


class Block:
    def __init__(self, row) -> None:
        self.id, self.words = int(row["block"]), _u64(row["words"])
        self.stream = np.frombuffer(row["stream"], np.uint32).astype(np.int64)
        self.doc_ids = list(row["doc_ids"])
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.in_train = np.repeat(self.train, self.lengths)

    def pairs(self):
        """Distinct (context, word) pairs as codes, the pair of each token, and
        each pair's occurrences in training.  The start of a text is the context
        one past the dictionary."""
        n = len(self.words)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = n
        codes, of = np.unique(before * n + self.stream, return_inverse=True)
        return codes // n, codes % n, of, np.bincount(of, self.in_train, len(codes)).astype(np.int64)


# ---- unigrams -----------------------------------------------------------------

_ASK = "part int, block long, items binary, counts binary"


def _ask_unigrams(parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                b = Block(row)
                n = len(b.words)
                trained, every = np.bincount(b.stream, b.in_train, n).astype(np.int64), np.bincount(b.stream, minlength=n)
                order, cuts = _cut((_mixed(b.words) % np.uint64(parts)).astype(np.int64))
                yield pd.DataFrame([(p, b.id, b.words[order[i:j]].tobytes(),
                                     _planes(np.concatenate([trained[order[i:j]], every[order[i:j]]])))
                                    for p, i, j in cuts], columns=["part", "block", "items", "counts"])
    return run


def _tally(counts: np.ndarray, k: int) -> list[int]:
    return np.bincount(np.minimum(counts, k + 2), minlength=k + 3)[1:k + 2].tolist()


def _answer_unigrams(k: int):
    """Per partition of words: totals in each block's order, and one row
    (block -1) with count-of-counts, types and tokens in training."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = [_u64(x) for x in frame["items"]]
        sent = [_from_planes(x, 2 * len(w)).reshape(2, -1) for x, w in zip(frame["counts"], words)]
        _, of = np.unique(np.concatenate(words), return_inverse=True)
        trained, every = (np.bincount(of, np.concatenate([s[i] for s in sent])).astype(np.int64) for i in (0, 1))
        part, rows, at = int(frame["part"].iloc[0]), [], 0
        for block, w in zip(frame["block"], words):
            mine = of[at:at + len(w)]
            rows.append((part, block, _planes(np.concatenate([trained[mine], every[mine]])), None))
            at += len(w)
        rows.append((part, -1, None, [*_tally(trained, k), int((trained > 0).sum()), int(trained.sum())]))
        return pd.DataFrame(rows, columns=["part", "block", "answer", "stats"])
    return run


_ANSWER = "part int, block long, answer binary, stats array<long>"


def _sums(answers: DataFrame, n: int) -> list[int]:
    row = answers.filter("block < 0").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [x or 0 for x in row]


def _unigram_counts(b: Block, parts: int, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences in training, everywhere) of the block's words."""
    order, cuts = _cut((_mixed(b.words) % np.uint64(parts)).astype(np.int64))
    got = dict(zip(answers["part"], answers["answer"]))
    trained, every = np.empty(len(b.words), np.int64), np.empty(len(b.words), np.int64)
    for p, i, j in cuts:
        trained[order[i:j]], every[order[i:j]] = _from_planes(got[p], 2 * (j - i)).reshape(2, -1)
    return trained, every


# ---- bigrams ------------------------------------------------------------------

class Asked:
    """A block's pairs in the order in which partitions are asked: runs of
    pairs with one (salted) context, by partition."""

    def __init__(self, b: Block, every: np.ndarray, parts: int, salt_tokens: int) -> None:
        n = len(b.words)
        self.context, self.word, self.of, self.counts = b.pairs()
        hashes = np.append(b.words, _START)
        seen = np.append(every, 0)
        contexts = np.unique(self.context)
        salts = 1 + seen[contexts] // salt_tokens
        # texts start as often as there are documents: no word tells that, so salt like the commonest
        salts[contexts == n] = 1 + int(every[n - 1]) // salt_tokens
        self.run_context = np.repeat(contexts, salts)
        salt = np.arange(len(self.run_context)) - np.repeat(np.cumsum(salts) - salts, salts)
        key = hashes[self.run_context] + salt.astype(np.uint64) * _GOLD
        part = (_mixed(key) % np.uint64(parts)).astype(np.int64)
        self.run_order, self.cuts = _cut(part)
        self.run_key, self.salted = key, np.repeat(salts > 1, salts)
        # each pair's run: the first run of its context and the salt of its word
        at = np.searchsorted(contexts, self.context)
        first = (np.cumsum(salts) - salts)[at]
        w48 = hashes[self.word] >> np.uint64(16)
        run = first + (_mixed(w48) % salts[at].astype(np.uint64)).astype(np.int64)
        place = np.empty(len(self.run_order), np.int64)
        place[self.run_order] = np.arange(len(self.run_order))
        self.pair_order = np.argsort(place[run], kind="stable")
        self.run_length = np.bincount(place[run], minlength=len(place))     # in asked order
        self.w48 = w48
        self.first_pair = np.concatenate([[0], np.cumsum(self.run_length)])


def _ask_bigrams(parts: int, uni_parts: int, salt_tokens: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in left.iterrows():
            b = Block(row)
            trained, every = _unigram_counts(b, uni_parts, right)
            q = Asked(b, every, parts, salt_tokens)
            for p, i, j in q.cuts:
                runs, pairs = q.run_order[i:j], q.pair_order[q.first_pair[i]:q.first_pair[j]]
                w = np.ascontiguousarray(q.w48[pairs]).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((p, b.id, q.run_key[runs].tobytes(), _planes(q.salted[runs]),
                             _planes(q.run_length[i:j]), w.tobytes(), _planes(q.counts[pairs]),
                             _planes(trained[q.word[pairs]])))
        return pd.DataFrame(rows, columns=["part", "block", "runs", "salted", "lengths", "words", "counts", "unigrams"])
    return run


_ASK2 = "part int, block long, runs binary, salted binary, lengths binary, words binary, counts binary, unigrams binary"


def _answer_bigrams(unigrams: Unigrams, k: int):
    """Per partition of contexts, for every block and in its order: counts of
    its pairs; whether each run's context has counts of k or less; and for
    runs with a pair unseen in training, or salted, the numbers of followers
    seen 1..k times and the unigram mass of all followers."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs = [_u64(x) for x in frame["runs"]]
        lengths = [_from_planes(x, len(r)) for x, r in zip(frame["lengths"], runs)]
        sizes = [int(n.sum()) for n in lengths]
        of_run = np.unique(np.concatenate(runs), return_inverse=True)[1]
        n_contexts = int(of_run.max()) + 1
        pair_context = np.repeat(of_run, np.concatenate(lengths))
        w = np.zeros((len(pair_context), 8), np.uint8)
        w[:, :6] = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["words"]]).reshape(-1, 6)
        key = _mixed(w.view(np.uint64).ravel() + _GOLD) ^ _mixed(pair_context.astype(np.uint64) * _GOLD + _MIX)
        del w
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        del key
        count = np.bincount(of, np.concatenate([_from_planes(*x) for x in zip(frame["counts"], sizes)]), len(first)).astype(np.int64)
        seen = count > 0
        context = pair_context[first]
        mass = unigrams.probability(np.concatenate([_from_planes(*x) for x in zip(frame["unigrams"], sizes)])[first])
        mass = np.bincount(context[seen], mass[seen], n_contexts)
        low = np.zeros((n_contexts, k), np.int64)
        few = seen & (count <= k)
        np.add.at(low, (context[few], count[few] - 1), 1)
        has_low = low.any(axis=1)
        part, rows, at_run, at = int(frame["part"].iloc[0]), [], 0, 0
        for block, r, n, m, s in zip(frame["block"], runs, lengths, sizes, frame["salted"]):
            mine, counts = of_run[at_run:at_run + len(r)], count[of[at:at + m]]
            unseen = np.bincount(np.repeat(np.arange(len(r)), n), counts == 0, len(r)) > 0
            told = np.flatnonzero(unseen | (_from_planes(s, len(r)) > 0))
            rows.append((part, block, _planes(counts), _planes(has_low[mine]), _planes(told),
                         _planes(low[mine[told]].ravel()), mass[mine[told]].tobytes(), None))
            at_run, at = at_run + len(r), at + m
        rows.append((part, -1, *[None] * 5, _tally(count, k)))
        return pd.DataFrame(rows, columns=["part", "block", "counts", "has_low", "told", "low", "mass", "stats"])
    return run


_ANSWER2 = "part int, block long, counts binary, has_low binary, told binary, low binary, mass binary, stats array<long>"
_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def pair_probability(count: np.ndarray, context_count: np.ndarray, word_p: np.ndarray, has_low: np.ndarray,
                     low: np.ndarray, mass: np.ndarray, d: np.ndarray, k: int = K) -> np.ndarray:
    """P(word | context) for pairs seen ``count`` times in contexts seen
    ``context_count`` times; ``low`` (followers seen 1..k times) and ``mass``
    (their unigram probability) matter for unseen pairs only."""
    room = np.where(has_low, 0.0, 1.0)
    total = np.maximum(context_count + room, 1.0)
    seen = np.where(count <= k, d[np.minimum(count, k)], 1.0) * count / total
    freed = (low * ((1 - d[1:]) * np.arange(1, k + 1))).sum(axis=1) + room
    backed = freed / total / np.maximum(1 - mass, 1e-300) * word_p
    return np.where(context_count == 0, word_p, np.where(count > 0, seen, backed))


def _score(parts: int, uni_parts: int, salt_tokens: int, unigrams: Unigrams, d: np.ndarray, n_docs: int, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            b = Block(row)
            trained, every = _unigram_counts(b, uni_parts, right[right["answer"].notna()])
            q = Asked(b, every, parts, salt_tokens)
            got = {r["part"]: r for _, r in right[right["counts"].notna()].iterrows()}
            n, n_runs = len(b.words), len(q.run_order)
            count = np.empty(len(q.context), np.int64)
            has_low, low, mass = np.zeros(n + 1, bool), np.zeros((n + 1, k), np.int64), np.zeros(n + 1)
            for p, i, j in q.cuts:
                a = got[p]
                mine = q.pair_order[q.first_pair[i]:q.first_pair[j]]
                count[mine] = _from_planes(a["counts"], len(mine))
                contexts = q.run_context[q.run_order[i:j]]
                np.logical_or.at(has_low, contexts, _from_planes(a["has_low"], j - i) > 0)
                masses = np.frombuffer(a["mass"])
                told = contexts[_from_planes(a["told"], len(masses))]
                np.add.at(low, told, _from_planes(a["low"], len(masses) * k).reshape(-1, k))
                np.add.at(mass, told, masses)
            context_count = np.append(trained, n_docs)
            context_count[n - 1] = 0            # nothing follows the end
            c = q.context
            p = pair_probability(count, context_count[c], unigrams.probability(trained[q.word]), has_low[c], low[c],
                                 mass[c], d, k)
            base = np.log10((trained + 1) / (unigrams.total + unigrams.types + 1))
            doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
            sums = lambda x: np.bincount(doc, x, len(b.lengths))
            out.append(pd.DataFrame({
                "doc_id": pd.array(b.doc_ids, "Int64"), "held_out": ~b.train, "n_tokens": b.lengths,
                "n_known": sums(trained[b.stream] > 0).astype(np.int64), "base_score": sums(base[b.stream]),
                "score": sums(np.log10(p)[q.of])}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in _SCORES.split(", ")])
    return run


def score(docs: DataFrame, k: int = K, part_items: int = PART_ITEMS, salt_tokens: int = SALT_TOKENS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    The model learns from the documents that are not held out (crc32 of the
    id's text modulo 7 is not 2; a null id is not held out).  Tokens are the
    words, A-Z lower-cased, and one end per text; null and empty texts are one
    end.  ``base_score`` is the add-one unigram model, ``score`` Katz, both
    log10 and summed over the text.  Repeated rows are trained on and scored
    each; extra columns are ignored; an empty table gives none, and without
    training documents every word is unknown.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"katz_blocks_{uuid.uuid4().hex}"
    try:
        (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, _BLOCK_DDL)
         .write.format("parquet").option("path", scratch_dir(spark, "llm", "blocks")).option("compression", "zstd")
         .bucketBy(buckets, "block").saveAsTable(name))
        blocks = spark.table(name)
        n_words, n_tokens, n_docs = blocks.agg(
            F.sum(F.octet_length("words") / 8), F.sum(F.octet_length("stream") / 4),
            F.sum(F.octet_length(F.regexp_replace(F.hex("train"), "00", "")) / 2)).first()
        uni_parts = max(1, int(-(-(n_words or 0) // part_items)))
        parts = max(1, int(-(-(n_tokens or 0) // (2 * part_items))))

        asked = blocks.mapInPandas(_ask_unigrams(uni_parts), _ASK)
        uni = written(asked.groupBy("part").applyInPandas(_answer_unigrams(k), _ANSWER), "unigrams")
        *tally, types, total = _sums(uni, k + 3)
        unigrams = Unigrams(total, types, tally, k)

        known = uni.filter("block >= 0").select("part", "block", "answer")
        asked = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
            _ask_bigrams(parts, uni_parts, salt_tokens), _ASK2)
        bi = written(asked.groupBy("part").applyInPandas(_answer_bigrams(unigrams, k), _ANSWER2), "bigrams")
        d = discounts(_sums(bi, k + 1), k)

        both = known.unionByName(bi.filter("block >= 0").drop("stats"), allowMissingColumns=True)
        out = written(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
            _score(parts, uni_parts, salt_tokens, unigrams, d, int(n_docs or 0), k), _SCORES), "scores")
    finally:      # the catalog keeps no trace of a run, ended or broken off
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out.withColumn("train_tokens", F.lit(total).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
