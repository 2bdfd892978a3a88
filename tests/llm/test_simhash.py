"""SimHash groups against brute force over all pairs."""

import random

import pytest
import xxhash

from cohortlens.llm import simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    """value -> least value reachable over links of two bits or fewer."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("text", ["", None, "a", "A b", "x y z", "Ünï ÇA b\tc\x0bd\x1ce f " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_links_keep_components(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:          # chains and dense clusters
        for _ in range(12):
            fps.add(f := f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = slow_groups(fps)
    for bucket in (2, 8, 64):          # small buckets send the clusters through the stars
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(
            spark.createDataFrame([(f,) for f in signed], "fp long"), 2, bucket).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        got = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(got[a], got[b])
                if got[a] != low or got[b] != low:
                    got[a] = got[b] = low
                    changed = True
        assert got == want


def test_groups_on_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "w7x ")
    rows = [(5, base, "x"), (3, near, None), (9, base, "x"), (9, base, "x"), (None, base, "y"), (4, None, "z"),
            (6, "", "z"), (1, "a b c d", "q"), (2, "long " * 50000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.groups(df).collect()
    assert len(out) == len(rows)
    fps = {t: slow_fingerprint(t) for _, t, _ in rows}
    want = slow_groups(set(fps.values()))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            g = want[fps[t]]
            least[g] = min(least.get(g, i), i)
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == sorted((i or -1, least[want[fps[t]]]) for i, t, _ in rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.groups(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0
