"""Toxicity, decontamination, winnowing."""

import hashlib
import random

import numpy as np

from cohortlens.llm import decontaminate as D
from cohortlens.llm import toxicity as X
from cohortlens.llm import winnowing as W


def test_gradient_orders_cuts():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 3, 3000)
    grades = np.clip(x + (rnd.random(3000) < 0.1), 0, 2)
    w, cuts = X.fit_cumulative(np.arange(3000), np.zeros(3000, int), x.astype(float), grades, 1, 2)
    assert w[0] > 0 and cuts[0] < cuts[1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = X.severity(docs, labels.filter("doc_id % 2 = 0")).filter("doc_id % 2 = 1").collect()
    got = [(r.toxic, truth[r.doc_id], r.expected_severity) for r in got if r.doc_id in truth]
    hit = sum(t for p, t, _ in got if p)
    assert hit / sum(t for _, t, _ in got) > 0.9
    assert hit / sum(p for p, _, _ in got) > 0.95
    assert np.mean([s for _, t, s in got if t]) > 5 * np.mean([s for _, t, s in got if not t])


def dense_fit(x, grades, n_cuts):
    """The cumulative logit by plain dense sums, one document after another."""
    n, f = x.shape
    share = [min(max(sum(g > k for g in grades) / n, 1e-4), 1 - 1e-4) for k in range(n_cuts)]
    start = [-np.log(s / (1 - s)) for s in share]
    params = np.concatenate([np.zeros(f), start[:1], [np.log(max(b - a, 1e-2)) for a, b in zip(start, start[1:])]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, X.STEPS + 1):
        w, gaps = params[:f], np.exp(params[f + 1:])
        cuts = np.concatenate([[params[f]], params[f] + np.cumsum(gaps)])
        grad_w, grad_cut = X.L2 * w, np.zeros(n_cuts)
        for row, g in zip(x, grades):
            s = row @ w
            hi = logistic(cuts[g] - s) if g < n_cuts else 1.0
            lo = logistic(cuts[g - 1] - s) if g else 0.0
            p = max(hi - lo, 1e-12)
            a, b = hi * (1 - hi) / p, lo * (1 - lo) / p
            grad_w = grad_w + (a - b) / n * row
            if g < n_cuts:
                grad_cut[g] -= a / n
            if g:
                grad_cut[g - 1] += b / n
        tail = np.cumsum(grad_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params = params - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[:f], np.concatenate([[params[f]], params[f] + np.cumsum(np.exp(params[f + 1:]))])


def test_fit_and_scores_by_hand(spark):
    """Selection, grades by the other half's markers, a dense refit, and every
    text's severity worked out again."""
    rnd = random.Random(12)
    bad, good = ["vile", "scum", "filthy", "rot"], ["fine", "day", "sun", "tree", "walk", "bread"]
    texts = {i: " ".join(rnd.choice(bad if i % 3 == 0 and rnd.random() < 0.5 else good) for _ in range(rnd.randint(3, 12))) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    rows = X.sample_of(docs, lab).collect()
    assert len(rows) == 120 and {r.half for r in rows} == {0, 1}

    def counted(text):
        out = {}
        for w in (text or "").lower().encode().split():
            for f in X.features_of(w):
                out[f] = out.get(f, 0) + 1
        return out

    def z_of(some):
        n, t = len(some), sum(r.toxic for r in some)
        seen = {}
        for r in some:
            for f in counted(r.text):
                c = seen.setdefault(f, [0, 0])
                c[0], c[1] = c[0] + 1, c[1] + r.toxic
        return {f: (b / t - (a - b) / (n - t)) / (max(a / n * (1 - a / n), 0.5 / n) * (1 / t + 1 / (n - t))) ** 0.5
                for f, (a, b) in seen.items() if a >= X.MIN_DOCS}
    z = z_of(rows)
    chosen = sorted((f for f in z if abs(z[f]) >= X.MIN_Z), key=lambda f: (-abs(z[f]), f))
    markers = [{f for f, x in z_of([r for r in rows if r.half == h]).items() if x >= X.MIN_Z} for h in (0, 1)]
    hits = [sum(min(n, X.CAP) for f, n in counted(r.text).items() if f in markers[1 - r.half]) for r in rows]
    edges = sorted(set(np.quantile([h for h, r in zip(hits, rows) if r.toxic], [k / X.GRADES for k in range(1, X.GRADES)])))
    raw = [1 + sum(h > e for e in edges) if r.toxic else 0 for h, r in zip(hits, rows)]
    grades = [sorted(set(raw)).index(g) for g in raw]
    assert max(grades) >= 2                                   # the other half's markers tell grades apart
    x = np.array([[min(counted(r.text).get(f, 0), X.CAP) for f in chosen] for r in rows], float)
    weights, cuts = dense_fit(x, grades, max(grades))
    model = X.fit(docs, lab)
    place = {f: i for f, i in model.index.items()}
    assert set(place) == set(chosen)
    assert np.allclose([model.weights[place[f]] for f in chosen], weights, atol=1e-6) and np.allclose(model.cuts, cuts, atol=1e-6)
    for r in X.severity(docs, lab).collect():
        c = counted(texts[r.doc_id])
        score = sum(weights[i] * min(c.get(f, 0), X.CAP) for i, f in enumerate(chosen))
        above = [1 / (1 + np.exp(t - score)) for t in cuts]
        assert abs(r.expected_severity - sum(above)) < 1e-5 and abs(r.p_toxic - above[0]) < 1e-5
        assert r.toxic == (above[0] > 0.5)
        shares = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert r.grade == shares.index(max(shares))


def test_given_grades_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = X.severity(docs, labels.filter("doc_id % 2 = 0")).filter("doc_id % 2 = 1").collect()
    got = [(r.p_toxic, truth[r.doc_id]) for r in got if truth.get(r.doc_id) is not None]
    # held-out rows: the mean probability is the share of toxic ones
    assert abs(np.mean([p for p, _ in got]) - np.mean([t for _, t in got])) < 0.03
    few = spark.createDataFrame([(i, ["fine day", "vile day", "vile scum"][i % 3] + " words here") for i in range(300)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), i % 3) for i in range(240)], "doc_id long, toxic int, grade int")
    for r in X.severity(few, lab).collect():
        assert r.grade == r.doc_id % 3


def test_toxicity_edges(spark):
    rows = [(i, ("vile scum " if i % 2 else "fine day ") + "word " * 5, "k") for i in range(200)]
    rows += [(900, None, "k"), (901, "", "k"), (None, "scum vile", "k"), (902, "word " * 200000, "k"), (1, rows[1][1], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (903, 1), (4, None)], "doc_id long, toxic int")
    got = {}
    for r in X.severity(df, lab).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[i].toxic == bool(i % 2) for i in range(200))
    assert got[None].toxic and not (got[900].toxic or got[901].toxic or got[902].toxic)
    kept = X.keep_clean(df, lab)
    assert kept.columns == df.columns and kept.count() == 103
    for few in (lab.filter("toxic = 0"), lab.limit(0)):
        assert not any(r.toxic or r.expected_severity for r in X.severity(df, few).collect())
    assert X.severity(df.limit(0), lab).count() == 0


def slow_search(index, terms):
    scores = {}
    for t in terms:
        for o, x in zip(index.items[t], index.impacts[t]):
            scores[o] = scores.get(o, 0) + x
    return {o for o, s in scores.items() if s >= index.threshold}


def test_wand_finds_all_above_threshold():
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 40)))) for i in range(300)]
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log(1 + (300 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for threshold in (0.05, 0.2, 0.5):
        index = D.Index(items, idf, 20.0, threshold=threshold, block=4)
        for _ in range(150):
            terms = sorted({index.terms.get(rnd.choice(vocabulary), 0) for _ in range(30)} - {0})
            found = index.search(terms)
            assert {o for o, _ in found} == slow_search(index, terms)


def test_leaks(spark):
    rnd = random.Random(5)
    words = [f"t{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, f"{say(rnd.randrange(8, 60))}.\n{say(8)}.") for i in range(40)] + [(50, "one two"), (51, None), (52, ""), (None, say(9)),
                                                                                 (53, say(900))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, say(400), "k") for i in range(60)]
    rows += [(100 + i, f"{say(150)} {t.upper()} {say(77)}", "k") for i, t in items[:40]]
    rows += [(200, None, "k"), (201, "", "k"), (None, items[3][1], "k"), (202, say(20000) + " " + items[4][1], "k"),
             (203, "x one two y", "k"), (204, items[5][1].split("\n")[0], "k"), (205, items[-1][1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    want = {(100 + i, i) for i in range(40)} | {(None, 3), (202, 4), (203, 50), (205, 53)}
    for pieces in ({}, {"piece_bytes": 2000}):
        assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, **pieces).collect()} == want
        kept = D.keep_clean(docs, bench, **pieces)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(range(60)) | {200, 201, 204}
    assert D.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_one_piece_at_a_time(spark, monkeypatch):
    """All pieces meet all texts; the piece that ends a pass isn't read again."""
    bench = spark.createDataFrame([(i, f"what is the colour of thing{i}? it is blue{i} as ever and always") for i in range(40)],
                                  "item_id long, text string")
    paths = D.stored(spark, D.indexes(bench, piece_bytes=600))
    assert len(paths) > 2
    read, store_of = [], D.store_of
    monkeypatch.setattr(D, "store_of", lambda path: read.append(path) or store_of(path))
    texts, pieces = [r.text for r in bench.orderBy("item_id").collect()] + [None, ""], D.Pieces(paths)
    for _ in range(3):
        found = {(i, item) for i, hits in pieces.through(texts) for item in hits}
        assert found == {(i, i) for i in range(40)}
    assert len(read) == 3 * len(paths) - 2
    alone, before = D.Pieces(paths[:1]), len(read)
    for _ in range(3):
        list(alone.through(texts))
    assert len(read) == before + 1


def slow_winnow(text, k, w):
    """Positions by the definition: least of each window, rightmost on ties."""
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    k = min(k, len(codes))
    h = [int(W.kgram_hashes(codes[i:i + k], k)[0]) for i in range(len(codes) - k + 1)]
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i:i + w])
        p = max(j for j in range(i, i + w) if h[j] == least)
        if not out or out[-1] != (least, p):
            out.append((least, p))
    return out


def test_winnow_by_definition(monkeypatch):
    rnd = random.Random(6)
    texts = ["", "a", "abc", "aaaa" * 30, "é😀" * 40, "".join(rnd.choice("ab ") for _ in range(700))]
    for chunk in (1 << 18, 64):
        monkeypatch.setattr(W, "_CHUNK", chunk)
        for t in texts:
            s = W.winnow(t, 5, 7)
            assert list(zip(W.hashes(s).tolist(), W.positions(s).tolist())) == slow_winnow(t, 5, 7)


def test_shared_passage_shares_a_hash():
    rnd = random.Random(7)
    r = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        p = r(W.K + W.WINDOW - 1)
        assert set(W.hashes(W.winnow(r(90) + p + r(80)))) & set(W.hashes(W.winnow(r(33) + p + r(60))))


def test_edited_texts(spark):
    rows = [(i * 3, f"doc {i} " * (i % 7), "k") for i in range(50)] + [(None, None, "k"), (9, "tie", "k"), (9, "tie", "k"), (400, "z" * 100000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(6)
    got = W.edit_likeness(df).collect()
    assert len(got) == len(rows)
    ids = sorted({i for i, _, _ in rows if i is not None}, reverse=True)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        if r.doc_id is None or r.doc_id in (9, 12):
            continue
        after = ids[ids.index(r.doc_id) + 1] if r.doc_id != ids[-1] else None
        t, n = text[r.doc_id], text[after]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        s = lambda x: set(W.hashes(W.winnow(x)).tolist())
        jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - jac(s(t), s(edited))) < 1e-12 and abs(r.near_next - jac(s(t), s(n))) < 1e-12
    one = W.edit_likeness(df.filter("doc_id = 400")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert W.edit_likeness(df.limit(0)).count() == 0
    assert W.fingerprints(df).count() == len(rows)
