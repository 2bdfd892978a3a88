"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds of spans are reported wherever they occur.  Weak parts, key ids and
user names, random-looking tokens and service addresses, are reported only
beside complementary parts: an interval join links identifiers, secrets and
endpoints that lie within ``gap`` code points of each other in one document.
A weak identifier needs a secret, a weak secret an identifier, an endpoint a
secret that is reported.

Matches come from ``regexp_extract_all``, their places from the lengths of what
``split`` leaves between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written

GAP = 200
#: Kind, role, weak, pattern, least length of the match (or of
#: the group given), in the order in which kinds at one place are listed.
KINDS = [
    ("assign", "secret", False,
     r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "id", False, r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", "secret", False, r"[0-9a-f]{24,}", 24, 0),
    ("weak_id", "id", True,
     r"""(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?i:user(?:_?name)?|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
     3, 0),
    ("weak_secret", "secret", True, r"[A-Za-z0-9+/]{32,}={0,2}", 32, 0),
    ("endpoint", "endpoint", True,
     r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""", 8, 0),
]
_ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}
_SPAN = "array<struct<start:int,rank:int,stop:int>>"
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an int array, itself included: sums of blocks, what is
    before each block, and the place in the block."""
    add = lambda a, x: a + x
    at = lambda i: F.floor(i / _BLOCK).cast("int")
    numbers = lambda a: F.sequence(F.lit(0), F.ceil(F.size(a) / _BLOCK).cast("int") - 1)
    blocks = lambda a: F.transform(numbers(a), lambda b: F.aggregate(
        F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))
    before = lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), add))
    return _let(lengths, lambda a: _let(blocks(a), lambda s: _let(before(s), lambda ahead: F.transform(
        a, lambda _, i: F.get(ahead, at(i)) + F.aggregate(
            F.slice(a, at(i) * _BLOCK + 1, i - at(i) * _BLOCK + 1), F.lit(0), add)))))


def spans(text: Column, kind: str) -> Column:
    """Spans (start, rank, stop) of one kind in a text: leftmost matches that
    do not overlap, those too short left out."""
    _, _, _, pattern, least, group = KINDS[_ORDER[kind]]
    sizes = lambda of: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(of)), lambda m: F.length(m))

    def placed(lengths: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(lengths)), lambda g: F.length(g))
        every = F.arrays_zip(_running(F.zip_with(gaps, lengths, lambda g, m: g + m)).alias("stop"),
                             lengths.alias("length"), (lengths if group == 0 else sizes(group)).alias("counted"))
        return F.transform(F.filter(every, lambda x: x["counted"] >= least), lambda x: F.struct(
            (x["stop"] - x["length"]).alias("start"), F.lit(_ORDER[kind]).alias("rank"), x["stop"].alias("stop")))
    return F.when(text.rlike(pattern), _let(sizes(0), placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def printed(spans_: Column) -> Column:
    """Spans as ``kind:start:stop``, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _parts(found: DataFrame, role: str, gap: int, reach: bool) -> DataFrame:
    """One row per part of a role and cell of ``gap`` code points that it lies
    in, or comes within ``gap`` of if ``reach``."""
    of_role = [_ORDER[k] for k, r, *_ in KINDS if r == role]
    more = gap if reach else 0
    rows = found.select("doc_id", "text_key", F.explode("parts").alias("p")).filter(F.col("p.rank").isin(of_role))
    first, last = F.floor((F.col("p.start") - more) / gap), F.floor((F.col("p.stop") + more) / gap)
    return rows.withColumn("cell", F.explode(F.sequence(first, last)))


def _linked(found: DataFrame, left: str, right: str, gap: int) -> DataFrame:
    """(doc_id, text_key, l, r): parts of two roles within ``gap`` of each other, once a pair."""
    a = _parts(found, left, gap, True).select(F.col("doc_id"), "text_key", "cell", F.col("p").alias("l"))
    b = _parts(found, right, gap, False).select(
        F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), F.col("cell").alias("b_cell"), F.col("p").alias("r"))
    apart = F.greatest(F.col("l.start"), F.col("r.start")) - F.least(F.col("l.stop"), F.col("r.stop"))
    return (a.join(b, a["doc_id"].eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key"))
                   & (F.col("cell") == F.col("b_cell")))
            .filter(apart <= gap).select("doc_id", "text_key", "l", "r").distinct())


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base (array of spans
    of the first three kinds), linked (array of weak spans with their
    complement).  A span is (start, rank in KINDS, stop) in code points.

    Null and empty texts have none, a null doc_id is kept, repeated rows stay,
    extra columns are ignored, an empty table gives none.  A weak part that
    overlaps a base span is not reported on its own account.
    """
    text = F.coalesce("text", F.lit(""))
    strong = F.concat(*[spans(F.col("t"), k) for k, _, weak, *_ in KINDS if not weak])
    weak = F.concat(*[spans(F.col("t"), k) for k, _, w, *_ in KINDS if w])
    found = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.xxhash64("t", F.length("t")).alias("text_key"), strong.alias("base"), weak.alias("weak"))
    found = written(found, "spans")
    # only documents with a weak part and another part can link
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    found = found.withColumn("weak", F.when(F.size("weak") + F.size("base") > 1, free).otherwise(F.array().cast(_SPAN)))
    linkable = written(found.filter(F.size("weak") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.concat("base", "weak").alias("parts")), "parts")

    rank_weak = [_ORDER[k] for k, _, w, *_ in KINDS if w]
    is_weak = lambda c: F.col(f"{c}.rank").isin(rank_weak)
    pairs = written(_linked(linkable, "id", "secret", gap), "credentials")
    named = pairs.filter(is_weak("l")).select("doc_id", "text_key", F.col("l").alias("p")).unionByName(
        pairs.filter(is_weak("r")).select("doc_id", "text_key", F.col("r").alias("p"))).distinct()
    near = _linked(linkable, "endpoint", "secret", gap)
    proven = pairs.select("doc_id", "text_key", "r").distinct()
    near = near.filter(~is_weak("r")).unionByName(near.filter(is_weak("r")).join(
        proven.select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("r").alias("p_r")),
        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")) & (F.col("r") == F.col("p_r")),
        "left_semi"))
    reported = named.unionByName(near.select("doc_id", "text_key", F.col("l").alias("p"))).distinct()
    reported = reported.groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).agg(
        F.collect_list("p").alias("linked"))
    out = found.join(reported, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def report(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == _ORDER[k])).cast("long")
    return scan(docs, gap).select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.concat("base", "linked")).alias("spans"))
