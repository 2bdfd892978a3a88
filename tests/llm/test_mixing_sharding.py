import math
import random

from cohortlens.llm import mixing, sharding


def docs(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)) or None, f"s{min(5, rnd.randrange(9))}" if i % 11 else None, rnd.random())
            for i in range(n)]
    rows += [(3, "same text", "s1", 0.5)] * 3 + [(None, "no id", "s1", None), (n + 1, "word " * 30000, "big", 0.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")


def slow_targets(sizes, weights, cap=3):
    full, left = {}, dict(zip(sizes, weights))
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        over = [s for s in left if rest * left[s] / sum(left.values()) >= cap * sizes[s]]
        if not over:
            return full | {s: rest * w / sum(left.values()) for s, w in left.items()}
        for s in over:
            full[s] = cap * sizes[s]
            del left[s]
        if not left:
            return full


def test_mix_meets_targets(spark):
    rows, df = docs(spark)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = slow_targets({s: sizes[s] for s in order}, [(1, 2, 3)[i % 3] for i in range(len(order))])
    got = mixing.mix(df, parts=20).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        whole = math.floor(math.floor(r.target + 0.5) / max(1, r.source_size))
        assert whole * r.size <= r.taken <= (whole + 1) * r.size      # complete epochs come first
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix(df.repartition(7), parts=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # the same documents whatever the number of ranges
    other = mixing.mix(df, parts=1).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in other)


def test_higher_quality_is_taken_first(spark):
    rows = [(i, "a b c d", "s", 4.0 if i % 2 else 0.25) for i in range(2000)] + [(5000 + i, "a " * 100, "t", 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = [r for r in mixing.mix(df, weights=(1, 12)).collect() if r.source == "s"]
    base = min(r.taken for r in got)
    good, bad = (sum(r.taken > base for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad


def test_mixed_rows(spark):
    _, df = docs(spark)
    plan = mixing.mix(df).groupBy().sum("copies").first()[0]
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == plan
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_labels_give_quality(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    lab = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r.quality for r in mixing.quality_weights(df, lab).collect()}
    assert got == {1: 1.0, 2: 0.25, 3: 0.625, None: 0.625}


def test_schedule_is_lpt():
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(1, 3000), "s") for i in range(600)] + [(1000 + i, "copy " * 20, "s") for i in range(50)]
    rows += [(7, None, "s"), (8, "", "s"), (8, "", "s"), (None, "é" * 40000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for grain in (2, 250):
        got = sharding.assign(df, shards=8, grain=grain, slot_rows=5).collect()
        assert len(got) == len(rows)
        loads, slots = {}, {}
        for r in got:
            loads[r.shard] = loads.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(loads.values()) - min(loads.values()) < sum(loads.values()) / 8 * (0.6 if grain == 2 else 0.02)
        assert len({r.shard for r in got if (r.doc_id or 0) >= 1000}) == 1
    again = sharding.assign(df.repartition(5), shards=8, grain=250, slot_rows=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = sharding.sharded(df, shards=8)
    assert sorted((str(r.doc_id), r.size, r.shard) for r in whole.collect()) == sorted((str(r.doc_id), r.size, r.shard) for r in got)
    placed = {(r.shard, r.slot) for r in whole.collect()}
    assert len(placed) == len(rows) and placed == {(r.shard, r.slot) for r in sharding.sharded(df.repartition(3), shards=8).collect()}
    assert sharding.assign(df.limit(0)).count() == 0 and sharding.sharded(df.limit(0)).count() == 0


def test_labels_give_the_same_mix_as_joined_qualities(spark):
    _, df = docs(spark)
    lab = spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 300, 2)] + [(2, 1), (None, 0)], "doc_id long, quality int")
    one = mixing.mix(df, parts=20, labels=lab).collect()
    two = mixing.mix(mixing.quality_weights(df, lab), parts=20).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    out = mixing.mixed(df, parts=20, labels=lab)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in one)


def test_no_part_is_much_larger_than_the_others(spark, monkeypatch):
    """Nine in ten rows of low quality, one source, many equal rows."""
    rows = [(i if i % 4 else 7, "a b c", "s", 0.25 if i % 10 else 1.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    seen = []
    real = mixing.written

    def spying(frame, name):
        out = real(frame, name)
        if name == "keys":
            seen.extend(r["count"] for r in out.groupBy("bucket").count().collect())
        return out
    monkeypatch.setattr(mixing, "written", spying)
    got = mixing.mix(df, parts=30)
    assert sum(r.taken for r in got.collect()) == 90_000
    assert len(seen) >= 25 and max(seen) < 3 * 30_000 / 30


def test_many_small_groups_come_near_the_full_schedule(spark):
    """No group is large enough to be scheduled alone: size classes against
    the heap over all groups."""
    rnd = random.Random(5)
    sizes = [int(rnd.paretovariate(1.1) * 20) + 17 for _ in range(6000)] + [5000] * 30 + [16] * 500
    sizes = [min(s, 20_000) for s in sizes]
    df = spark.createDataFrame(list(enumerate(sizes)), "grp long, bytes long")
    for shards, grain in ((8, 3), (8, 40), (40, 5)):
        total, best = sum(sizes), sharding.schedule(list(enumerate(sizes)), shards)
        full = [0] * shards
        for i, s in best.items():
            full[s] += sizes[i]
        got, ours = sharding.group_shards(df, shards, grain).collect(), [0] * shards
        assert sorted((r.grp, r.bytes) for r in got) == list(enumerate(sizes))
        for r in got:
            ours[r.shard] += r.bytes
        step = total / (shards * grain)
        assert max(ours) - min(ours) <= max(full) - min(full) + 2 * step
        by_count = [0] * shards
        for r in got:
            by_count[r.shard] += r.bytes <= 100
        assert max(by_count) < 1.6 * min(by_count) + 2 or grain < 10      # each class is spread over all shards
