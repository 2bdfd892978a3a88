"""Registered queries of the training-data operators (production parameters,
whole tables) and their SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.llm import (decontaminate, katz, mixing, private_data, ranked_search, reputation, secrets, sharding,
                            simhash, toxicity, vector_codes, warc, winnowing)

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_components")
def op1(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "links")


@query("op2_warc_round_trip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                  CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN least END AS refers_to
FROM f""")
def op2(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op3_mix_sources")
def op3(spark, sf_dir):
    mix = mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_shard_lpt")
def op4(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_toxicity_severity")
def op5(spark, sf_dir):
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_katz_scores")
def op6(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"))


@query("op7_benchmark_leaks")
def op7(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_winnow_fingerprints")
def op8(spark, sf_dir):
    return winnowing.edit_likeness(table(spark, sf_dir, "documents"))


@query("op9_linked_secrets")
def op9(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


#: A page's outcome is its document's label; the number in the url's path is the document's id.
def page_outcomes(pages, labels):
    doc = F.regexp_extract(reputation.path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    of = pages.select("page_id", F.when(doc != "", doc.cast("long")).alias("doc_id"))
    return of.join(labels.select(F.col("doc_id").alias("l_id"), bad.alias("bad")),
                   F.col("doc_id") == F.col("l_id")).select("page_id", "bad")


@query("op10_host_reputation")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return reputation.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select(
        "page_id", "host", "path", "rule", "verdict")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT k, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
tf AS (SELECT k, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, doc_id, n, unnest(t) AS term FROM docs)
       GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c
      GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))
             AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, k, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""")
def op11(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_private_spans")
def op12(spark, sf_dir):
    return private_data.report(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """The rounds unrolled; ``x`` holds a row per vector, part and position."""
    nearest = ("SELECT k, p, e, d FROM (SELECT k, p, e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {b} b USING (p, i) "
               "GROUP BY k, p, e) QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY d, e) = 1")
    steps = [f"b0 AS (SELECT k - 1 AS e, p, i, v FROM x WHERE k <= {entries})"]
    for r in range(rounds):
        steps += [f"n{r} AS ({nearest.format(b=f'b{r}')})",
                  f"m{r} AS (SELECT e, p, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM x JOIN n{r} USING (k, p) GROUP BY e, p, i)",
                  f"b{r + 1} AS (SELECT e, p, i, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} USING (e, p, i))"]
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS (SELECT k, (j - 1) // (len(embedding) // {parts}) AS p, (j - 1) % (len(embedding) // {parts}) AS i,
  CAST(floor(256 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT k, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM kept)),
{", ".join(steps)},
z AS ({nearest.format(b=f"b{rounds}")}),
o AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY k),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN o USING (k), h"""


@query("op13_vector_codes", _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS))
def op13(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))
