"""Katz scores against a plain model, and its normalisation."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import katz
from cohortlens.llm.common import words_of


class Slow:
    """The model by its definition, on word tuples."""

    def __init__(self, rows, k=katz.K):
        self.k, self.uni, pairs = k, Counter(), Counter()
        for i, t in rows:
            if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
                before = b" start"
                for w in [*words_of(t), b" end"]:
                    self.uni[w] += 1
                    pairs[before, w] += 1
                    before = w
        self.n = sum(self.uni.values())
        tally = lambda c: [sum(x == r for x in c.values()) for r in range(1, k + 2)]
        self.u, self.d = katz.Unigrams(self.n, len(self.uni), tally(self.uni)), katz.discounts(tally(pairs))
        self.after, self.mass = defaultdict(dict), {}
        for (v, w), c in pairs.items():
            self.after[v][w] = c

    def one(self, w):
        return float(self.u.probability(np.array([self.uni.get(w, 0)]))[0])

    def p(self, w, v):
        f = self.after.get(v)
        if not f:
            return self.one(w)
        low = [c for c in f.values() if c <= self.k]
        total = sum(f.values()) + (not low)
        if w in f:
            return (self.d[f[w]] if f[w] <= self.k else 1) * f[w] / total
        if v not in self.mass:
            self.mass[v] = sum(map(self.one, f))
        return (sum((1 - self.d[c]) * c for c in low) + (not low)) / total / (1 - self.mass[v]) * self.one(w)

    def score(self, t):
        toks = [*words_of(t), b" end"]
        base = sum(math.log10((self.uni.get(w, 0) + 1) / (self.n + len(self.uni) + 1)) for w in toks)
        return (len(toks), sum(w in self.uni for w in toks), self.n, base,
                sum(math.log10(self.p(w, v)) for v, w in zip([b" start", *toks], toks)))


EDGE = [(1, "a b a b A", "k"), (2, None, "k"), (3, "", "k"), (None, "a c", "k"), (3, "", "k"), (5, "z " * 3000, "k"),
        *[(i, "the of " * (i % 5) + f"w{i % 9}", "k") for i in range(10, 90)]]


@pytest.mark.parametrize("options", [{}, {"part_items": 5, "salt_tokens": 20}])
def test_scores(spark, options):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, score string").repartition(3)
    slow = Slow([r[:2] for r in EDGE])
    got = katz.score(df, **options).collect()
    assert len(got) == len(EDGE)
    want = sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 7 == 2, *slow.score(t)) for i, t, _ in EDGE)
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), want):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6 and abs(r.score - w[6]) < 1e-6


def test_every_context_sums_to_one():
    slow = Slow([r[:2] for r in EDGE])
    for v in [*slow.after, b"never seen"]:
        assert abs(sum(slow.p(w, v) for w in slow.uni) + slow.p(b"never seen", v) - 1) < 1e-9


def test_beats_the_base_model(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = katz.score(df).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_empty_and_untrained(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, score string")
    assert katz.score(df.limit(0)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    out = katz.score(spark.createDataFrame([(held[0], "x y")], "doc_id long, text string")).first()
    assert (out.train_tokens, out.n_known, out.held_out) == (0, 0, True) and out.score == 0


def test_discounts_are_proper():
    for counts in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 12, 8, 6], [10, 50, 1, 1, 1, 1]):
        d = katz.discounts(counts)
        assert len(d) == katz.K + 1 and all(0 < x < 1 for x in d[1:])
