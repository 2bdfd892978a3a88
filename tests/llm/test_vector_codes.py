"""Vector codes against big-integer brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortlens.llm import vector_codes as V


def slow(rows, parts, entries, rounds, scale=256):
    """rows: (vec_id, vector, label), usable, of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)
    def cut(v):
        ints = [int(x) * scale if abs(x) > 1e15 else math.floor(x * scale) for x in v] + [0] * (width * parts - len(v))
        return [ints[p * width:(p + 1) * width] for p in range(parts)]
    xs = [cut(r[1]) for r in rows]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]
    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in xs:
                groups.setdefault(best(x[p], books[p])[1], []).append(x[p])
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for r, x in zip(rows, xs):
        found = [best(x[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
    text = ",".join(str(v) for b in books for e in b for v in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("bits", [3, 20, 30, 45, 80])
def test_dot_and_nearest_are_exact(bits):
    rnd = random.Random(bits)
    def matrix(n):
        rows = [[rnd.randint(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(n)]
        return np.array(rows, np.int64 if bits < 62 else object)
    a, b = matrix(40), matrix(17)
    b[9] = b[4]
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert V.exact_dot(a, b).tolist() == want
    at, far = V.nearest(a, b)
    for i, r in enumerate(a):
        d = [sum((int(x) - int(y)) ** 2 for x, y in zip(r, s)) for s in b]
        assert (int(at[i]), int(far[i])) == (d.index(min(d)), min(d))
    near, _ = V.nearest(b, b)
    assert near[9] == 4                                # ties to the lower index
    if bits < 62:
        assert all(np.abs(x).max() <= 1 << 25 for x in V.limbs(a, 25))


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-2, 2)]) for _ in range(8)], rnd.choice([0, 1, None]))
            for i in range(150)]
    rows += [rows[3], rows[70], (None, [0.1] * 8, 5), (500, [3e20] * 8, 6), (501, [-70000.3] * 8, 6)]
    bad = [(600, None, 1), (601, [None] * 8, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(i, v, x, "k") for i, v, x in rows + bad],
                               "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = V.compress(df, parts=4, entries=10).collect()
    want, digest = slow(rows, 4, 10, 2)
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=key) == sorted(
        [(i, c, e if e < 1 << 63 else None) for i, c, e, _ in want], key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + (e if e < 1 << 63 else 0)
    by = {(i, c): label for i, c, _, label in want}
    assert all(r.label_error == sums[by[(r.vec_id, r.code)]] for r in got)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want, digest = slow([(r.vec_id, [float(x) for x in r.embedding], r.label) for r in df.collect()], 16, 64, 2)
    got = V.compress(df).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, c, e) for i, c, e, _ in want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a"), (2, [1.0], None), (3, [1.0, 2.0, 3.5], None), (0, None, "a")], schema)
    got = {r.vec_id: r for r in V.compress(df, parts=2, entries=1).collect()}
    assert set(got) == {1, 2, 3} and got[2].code is None and got[2].error is None
    assert got[1].code == "0000" and got[1].label_error == got[1].error
    assert got[3].label_error == got[3].error
    assert V.compress(df.limit(0)).count() == 0
    none = V.compress(spark.createDataFrame([(4, [], None), (5, [], None)], schema)).collect()
    assert [(r.code, r.error) for r in none] == [("00" * 16, 0)] * 2
