"""NRA search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from cohortlens.llm import ranked_search as R

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def slow(docs, items, top=50):
    texts = [(i, _TERM.findall((t or "").translate(_LOWER))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    out = []
    for item, text in items:
        scores = [0] * n
        for term in set(_TERM.findall((text or "").translate(_LOWER))):
            df = sum(term in t for _, t in texts)
            for k, (_, t) in enumerate(texts):
                if tf := t.count(term):
                    m = 100 - 50 + (50 * len(t) * n) // total
                    scores[k] += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (
                        (1000000000 * tf) // (1000 * tf + 20 * m))
        best = sorted((-s, i is None, i or 0) for s, (i, _) in zip(scores, texts) if s > 0)[:top]
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(best, 1)]
    return out


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    def text():
        return " ".join(words[min(199, int(rnd.paretovariate(0.6)) - 1)] for _ in range(rnd.randint(0, 30)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)] + [docs[5], (None, docs[2][1]), (9000, None), (9001, " .,; "),
                                                            (9002, "É́t W1 w1-W2 " * 3), (9003, docs[3][1] * 2000)]
    items = [(i, text() + " zzz") for i in range(12)] + [(50, None), (51, "..."), (52, "w1 w1 W1"), (None, "w2 w3")]
    return docs, items


@pytest.mark.parametrize("shard", [(R.SHARD_DOCS, R.SHARD_POSTINGS), (17, 60)])
def test_matches_scoring_every_document(spark, monkeypatch, shard):
    docs, items = corpus(3)
    monkeypatch.setattr(R, "SHARD_DOCS", shard[0])
    monkeypatch.setattr(R, "SHARD_POSTINGS", shard[1])
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = rows_of(R.search(d, q))
    assert got == sorted(slow(docs, items), key=str)
    assert rows_of(R.search(d, q, piece_bytes=200)) == got                  # many pieces
    assert rows_of(R.search(d, q.unionByName(q), top=3)) == sorted(slow(docs, items, 3), key=str)


def test_reads_no_more_than_it_needs():
    """A few outstanding documents are settled before the lists end."""
    n = 100_000
    docs = np.tile(np.arange(n), 2)
    impact = np.where(docs < 5, 900_000 - docs, 10)
    shard = R.Shard(np.arange(n), np.repeat([0, 1], n), docs, impact, 2)
    seen = []
    shard.docs = shard.docs.view(type("Seen", (np.ndarray,), {
        "__getitem__": lambda self, k: (seen.append(k), np.ndarray.__getitem__(self, k))[1]}))
    at, score = shard.nra([0, 1], np.array([3, 2]), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and score.tolist() == [5 * (900_000 - i) for i in range(5)]
    assert max(k.stop for k in seen if isinstance(k, slice)) <= n + R.FIRST_READ


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows_of(R.search(d.limit(0), q)) == [] and rows_of(R.search(d, q.limit(0))) == []
    assert [r[:3] for r in rows_of(R.search(d, q))] == [(1, 1, 1)]
