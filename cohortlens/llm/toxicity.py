"""Toxicity: cumulative-link ordinal regression on sparse text features.

The model is P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all
thresholds t_0 < t_1 < ...; a document's expected severity is the sum of these
probabilities, and it is rejected if grade 0 has less than half.  Features are
capped counts of words (A-Z lower-cased, ASCII punctuation stripped) and of word
beginnings, so inflected forms of a marked stem count as well.

Grades are the labels' own where they have a column ``grade`` (0: clean).  Binary
labels get grades from the text, and not from what the same documents taught:
the sample is halved by a hash of the id, marker features (those
over-represented in toxic documents) are found in each half, and a toxic
document's grade is the quantile group of its number of markers of the other
half.

Fitting uses at most about ``sample`` labelled rows, chosen by a hash of the id;
feature counts are aggregated by Spark, the few selected features' matrix is
fitted in one task.  Scoring reads every whole text of the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ship, words_of, written

SAMPLE_ROWS = 20_000
MAX_FEATURES = 2000
MIN_Z = 4.0
MIN_DOCS = 5
GRADES = 3
CAP = 4
PREFIXES = (4, 5, 6)
L2 = 1e-3
STEPS = 600
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHE = 1 << 20


def features_of(word: bytes) -> list[bytes]:
    """The features a word counts for: itself and its beginnings."""
    w = word.strip(_PUNCT)
    if not w:
        return []
    s = w.decode("utf-8", "surrogatepass")
    return [b"=" + w] + [b"^" + s[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(s) >= n]


class _Cached(dict):
    """word -> value, worked out once; forgotten when it has grown large."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) > _CACHE:
            self.clear()
        v = self[word] = self.of(word)
        return v


@dataclass(frozen=True)
class Model:
    """``index``: feature -> position in ``weights``; ``cuts``: the ordered thresholds."""

    index: dict[bytes, int]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def known(self):
        """word -> positions of its features, as a cached lookup."""
        index = self.index
        return _Cached(lambda w: tuple(i for f in features_of(w) if (i := index.get(f)) is not None))

    def counts(self, text: str | None, known) -> Counter:
        return Counter(i for hit in map(known.__getitem__, words_of(text)) if hit for i in hit)

    def above(self, text: str | None, known) -> np.ndarray:
        """P(grade > k) for each k."""
        score = sum(self.weights[i] * min(n, CAP) for i, n in self.counts(text, known).items())
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts) - score, -500, 500)))


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                   n_cuts: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of the cumulative logit model for a sparse
    matrix in coordinate form, by Adam on the mean log-likelihood.

    The cuts are the first one and positive steps exp(.) above it, so they
    stay in order."""
    n = len(grades)
    share = np.array([(grades > k).mean() for k in range(n_cuts)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1:])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[cols] * values, n)
        # P(grade = g) = F(cut_g - s) - F(cut_{g-1} - s), F the logistic function
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        z_hi, z_lo = bounds[grades + 1] - score, bounds[grades] - score
        f = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        hi, lo = np.where(np.isinf(z_hi), 1.0, f(z_hi)), np.where(np.isinf(z_lo), 0.0, f(z_lo))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p      # of log p by the two bounds
        g_score = (d_hi - d_lo) / n                            # of -log p by the score
        g_w = np.bincount(cols, g_score[rows] * values, n_features) + l2 * w
        g_cut = np.array([(d_lo[grades == k + 1].sum() - d_hi[grades == k].sum()) / n for k in range(n_cuts)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params = params - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    cuts = params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1:]))])
    return params[:n_features], cuts


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, docs and toxic docs of either half), summed over the task's rows so far."""
    known, counts = _Cached(lambda w: tuple(features_of(w))), {}

    def out():
        keys = list(counts)
        return pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.binary())} | {
            name: pa.array([counts[k][i] for k in keys], pa.int64()) for i, name in enumerate(("n0", "t0", "n1", "t1"))})

    for batch in batches:
        for text, toxic, half in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "half"))):
            for f in {f for w in set(words_of(text)) for f in known[w]}:
                c = counts.setdefault(f, [0, 0, 0, 0])
                c[2 * half] += 1
                c[2 * half + 1] += toxic
        if len(counts) > 500_000:
            yield out()
            counts = {}
    yield out()


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, grade, half) of about ``sample`` labelled documents at most,
    by a hash of the id.  Several labels of a document count as toxic if any is,
    and as the highest grade; ``grade`` is null where labels have none."""
    grade = F.max("grade").cast("int") if "grade" in labels.columns else F.lit(None).cast("int")
    of = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
          .agg(F.max("toxic").cast("int").alias("__toxic"), grade.alias("__grade")))
    n = of.count()
    u = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(1 << 20)) / float(1 << 20)
    of = of.filter(u < min(1.0, sample / max(1, n)))
    return docs.select("doc_id", "text").join(of, F.col("doc_id") == F.col("__id")).select(
        "text", F.col("__toxic").alias("toxic"), F.col("__grade").alias("grade"),
        F.pmod(F.xxhash64(F.lit(6), "__id"), F.lit(2)).cast("int").alias("half"))


def _z(n, t, docs: int, toxic: int):
    """How far a feature's share of the toxic documents lies from its share of
    the others, in standard deviations: ``n`` documents have it, ``t`` toxic ones."""
    p = n / docs
    return (t / toxic - (n - t) / (docs - toxic)) / F.sqrt(
        F.greatest(p * (1 - p), F.lit(0.5 / docs)) * (1 / toxic + 1 / (docs - toxic)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES,
        grades: int = GRADES) -> Model | None:
    """The model, or None if the labelled documents are not of both classes or
    no feature tells them apart.  A given grade that makes all rows one grade
    counts as one class."""
    ship(docs.sparkSession)
    rows = written(sample_of(docs, labels, sample), "labelled")
    halves = {r["half"]: (r["n"], r["t"]) for r in rows.groupBy("half").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}
    n, n_toxic = (sum(h[i] for h in halves.values()) for i in (0, 1))
    if not n or not n_toxic or n == n_toxic:
        return None
    seen = written(rows.mapInArrow(_feature_counts, "feature binary, n0 long, t0 long, n1 long, t1 long").groupBy("feature")
                   .agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]), "features")

    def selected(n_col, t_col, docs: int, toxic: int, only_toxic: bool) -> list:
        if not toxic or toxic == docs:
            return []
        z = _z(n_col, t_col, docs, toxic)
        far = z if only_toxic else F.abs(z)
        return (seen.filter(n_col >= MIN_DOCS).select("feature", z.alias("z"), far.alias("far")).filter(F.col("far") >= MIN_Z)
                .orderBy(F.desc("far"), "feature").limit(max_features).collect())

    chosen = selected(F.col("n0") + F.col("n1"), F.col("t0") + F.col("t1"), n, n_toxic, False)
    if not any(r["z"] > 0 for r in chosen):
        return None
    index = {bytes(r["feature"]): i for i, r in enumerate(chosen)}
    # markers of either half, known to the tasks beside the features, and no input of the model
    known_all = dict(index)
    markers = [[known_all.setdefault(bytes(r["feature"]), len(known_all))
                for r in selected(F.col(f"n{h}"), F.col(f"t{h}"), *halves.get(h, (0, 0)), True)] for h in (0, 1)]
    blank = Model(known_all, (), ())

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blank.known()
        for batch in batches:
            found = [blank.counts(t, known) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], batch["grade"], batch["half"], pa.array([list(c) for c in found], pa.list_(pa.int32())),
                 pa.array([[min(x, CAP) for x in c.values()] for c in found], pa.list_(pa.int32()))],
                ["toxic", "grade", "half", "cols", "vals"])

    n_features, cuts_wanted = len(chosen), grades
    counts_for = [np.isin(np.arange(len(known_all)), markers[1 - h]) for h in (0, 1)]      # the other half's

    def one_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(sorted(zip(c, v))) for c, v in zip(pdf["cols"], pdf["vals"])])
        pdf = pdf.sort_values(["toxic", "half", "key"]).reset_index(drop=True)   # same sums in every run
        rows_ = np.repeat(np.arange(len(pdf)), pdf["key"].map(len))
        cols = np.array([c for k in pdf["key"] for c, _ in k], int)
        vals = np.array([v for k in pdf["key"] for _, v in k], float)
        half = pdf["half"].to_numpy(int)
        of_other = np.where(half[rows_] == 0, counts_for[0][cols], counts_for[1][cols])
        hits = np.bincount(rows_, of_other * vals, len(pdf))
        toxic = pdf["toxic"].to_numpy() > 0
        edges = np.quantile(hits[toxic], [k / cuts_wanted for k in range(1, cuts_wanted)])
        grade = np.where(toxic, 1 + np.searchsorted(np.unique(edges), hits, side="left"), 0)
        given = pdf["grade"].to_numpy(float)
        grade = np.where(np.isnan(given), grade, np.nan_to_num(given)).astype(int)
        _, grade = np.unique(grade, return_inverse=True)          # no empty grade
        own = cols < n_features
        w, cuts = fit_cumulative(rows_[own], cols[own], vals[own], grade, n_features, int(grade.max()))
        return pd.DataFrame({"weights": [w.tolist()], "cuts": [cuts.tolist()]})

    fitted = (rows.mapInArrow(sparse, "toxic int, grade int, half int, cols array<int>, vals array<int>").groupBy(F.lit(0).alias("one"))
              .applyInPandas(one_fit, "weights array<double>, cuts array<double>").first())
    return Model(index, tuple(fitted["weights"]), tuple(fitted["cuts"]))


_SCORE = "expected_severity double, p_toxic double, grade int"


def _scorer(model: Model | None):
    @F.pandas_udf(_SCORE)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = model.known() if model else None
        for batch in texts:
            if model is None:
                above = np.zeros((len(batch), 1))
            else:
                above = np.array([model.above(t, known) for t in batch]).reshape(len(batch), -1)
            grades = -np.diff(np.concatenate([np.ones((len(batch), 1)), above, np.zeros((len(batch), 1))], 1), axis=1)
            yield pd.DataFrame({"expected_severity": above.sum(1), "p_toxic": above[:, 0],
                                "grade": grades.argmax(1).astype("int32")})
    return of


def severity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_severity, p_toxic, grade
    (the likeliest), toxic (p_toxic over one half).

    Null and empty texts have no features and get the severity of a document
    without any.  Labels without documents, null labels and null ids are left
    out of the fit.  Without both classes among the labels nothing is toxic and
    every severity is 0.  Repeated rows stay, extra columns are ignored.
    """
    score = _scorer(fit(docs, labels, **options))
    return (docs.select("doc_id", score(F.col("text")).alias("s"))
            .select("doc_id", "s.*", (F.col("s.p_toxic") > 0.5).alias("toxic")))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns: null and
    empty texts stay, as do all rows where the labels tell nothing; repeated rows
    are judged alike; an empty table gives none."""
    score = _scorer(fit(docs, labels, **options))
    return docs.filter(score(F.col("text"))["p_toxic"] <= 0.5)
