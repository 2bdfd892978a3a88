"""The corpus pipeline: every stage against brute force on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortlens.llm import decontaminate as D
from cohortlens.llm import mixing as M
from cohortlens.llm.common import written

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows before, rows after), in the order of the pipeline."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df, columns=None):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_columns_and_rows_are_kept(stages):
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, (before, after) in stages.items():
        a, b = Counter(rows(before)), Counter(rows(after, before.columns))
        if name in ("mixing", "sharding"):
            assert set(b) <= set(a)
        else:
            assert not b - a
        if name != "sharding":
            assert after.columns == before.columns
        else:
            assert a == b


def test_toxic_go_clean_stay(spark):
    """On the table with labels enough to learn from."""
    sf = "/root/testdata/sf0.1"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r[0] for r in rows(P.drop_toxic(spark, before, sf), ["doc_id"])}
    got = [(truth[d], d in kept) for (d,) in rows(before, ["doc_id"]) if d in truth]
    toxic, clean = [k for t, k in got if t], [k for t, k in got if not t]
    assert toxic and 1 - np.mean(toxic) > 0.9
    assert np.mean(clean) > 0.99


def slow_fingerprint(text):
    w = WORDS.findall(lower(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    docs = sorted(rows(before, ["doc_id", "text"]))
    fps = np.array([slow_fingerprint(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    least = {docs[find(i)][0] for i in range(len(docs))}
    assert len(least) < len(docs)
    assert sorted(d for (d,) in rows(after, ["doc_id"])) == sorted(least)


def test_leaks_go_others_stay(spark, stages):
    before, after = stages["decontamination"]
    items = [(D.tokens(r.text), D.question_length(r.text))
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if D.tokens(r.text)]
    kept = {r[0] for r in rows(after, ["doc_id"])}
    for doc_id, text in rows(before, ["doc_id", "text"]):
        words = D.tokens(text)
        joined = " " + " ".join(words) + " "
        whole = any(" " + " ".join(item) + " " in joined for item, _ in items)
        if whole:
            assert doc_id not in kept
        if doc_id not in kept:
            there = {tuple(words[i:i + D.SHINGLE]) for i in range(len(words))}
            near = False
            for item, asked in items:
                covered = np.zeros(len(item), bool)
                for i in range(len(item) - D.SHINGLE + 1):
                    if tuple(item[i:i + D.SHINGLE]) in there:
                        covered[i:i + D.SHINGLE] = True
                q, a = covered[:asked], covered[asked:]
                near |= (q.mean() if len(q) else 1) >= 0.8 and (a.mean() if len(a) else 1) >= 0.5
            assert whole or near
    assert len(kept) < before.count()


def test_sources_meet_their_targets(spark, stages):
    before, after = stages["mixing"]
    size = defaultdict(int)
    most = defaultdict(int)
    for source, text in rows(before, ["source", "text"]):
        n = len(WORDS.findall(text or ""))
        size[source] += n
        most[source] = max(most[source], n)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / free for s in order}
        more = {s for s in order if s not in full and target[s] >= 3 * size[s]}
        if not more or more | full == set(order):
            break
        full |= more
    taken = defaultdict(int)
    for source, text in rows(after, ["source", "text"]):
        taken[source] += len(WORDS.findall(text or ""))
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] + 1
    plan = M.mix(before, labels=spark.read.parquet(f"{SF}/labels.parquet"))
    wanted = Counter({r.doc_id: r.copies for r in plan.collect() if r.copies})
    assert Counter(d for (d,) in rows(after, ["doc_id"])) == wanted


def test_shards_are_level(stages):
    _, after = stages["sharding"]
    slots, load, at, group = defaultdict(list), defaultdict(int), {}, defaultdict(int)
    for text, size, shard, slot in rows(after, ["text", "size", "shard", "slot"]):
        assert size == len((text or "").encode()) + 16
        slots[shard].append(slot)
        load[shard] += size
        group[text] += size
        assert at.setdefault(text, shard) == shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(40))
    assert max(load.values()) <= 1.1 * sum(load.values()) / 40 + max(group.values())


def test_odd_rows_and_empty_table(spark, tmp_path):
    """Nulls, empty and repeated texts and clashing extra columns pass every
    stage; an empty table gives no row."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/odd/{name}.parquet")
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {c: F.when(F.col("doc_id") >= 0, "x") for c in ("size", "shard", "slot", "quality", "fp", "toxic", "n", "key")})
    none = {f.name: None for f in docs.schema}
    odd = [{**none}, {**none}, {**none, "doc_id": 10 ** 6, "text": ""}, {**none, "doc_id": 10 ** 6 + 1, "text": "one"},
           {**none, "doc_id": 10 ** 6 + 2, "source": "web", "text": "long " * 50_000}]
    odd = spark.createDataFrame([tuple(r.values()) for r in odd], docs.schema)
    docs.limit(60).union(odd).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = P.run(spark, f"{tmp_path}/odd")
    assert set(docs.columns) == set(got.columns)
    assert {r.shard for r in got.select("shard").collect()} <= set(range(40))
    assert got.count() > 0
    assert P.run(spark, f"{tmp_path}/none").count() == 0
