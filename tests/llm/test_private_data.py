"""Personal data: base spans against the patterns as written, disguises by case."""

import hashlib
import random
import re
import time

import pytest

from cohortlens.llm import private_data as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns, one after another, failing matches dropped."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [x * 2 if i % 2 else x for i, x in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_on_random_texts():
    rnd = random.Random(8)
    pieces = ["a", "B", "7", "42", "255", "256", "0001", "@", "@", ".", ".", "-", "+", "+1", " ", " ", "(", ")", "_", "%", "é",
              "x@y.z", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "٣", "\n", "Ａ"]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        got = sorted((s, k, e, kind) for k, (kind, spans) in enumerate(P.detect(text).items()) for s, e in spans)
        assert got == plain(text), text


@pytest.mark.parametrize("kind,text", [
    ("email", "john dot smith at example dot co dot uk"),
    ("email", "john.smith [at] example [dot] com"),
    ("email", "john(at)example.com"),
    ("email", "john @ example . com"),
    ("email", "jane arroba correo punto es"),
    ("email", "jоhn@example.com"),                     # Cyrillic o
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "jo​hn@exam­ple.com"),
    ("phone", "plus one two zero two five five five zero one four seven"),
    ("phone", "+१ (२०२) ५५५-०१४७"),
    ("phone", "+1 202 555 0147"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "quatre un un un 1111 1111 1111"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "10[.]0[.]0[.]7"),
    ("ip", "192 dot 168 dot 0 dot 1"),
])
def test_disguises_map_back_to_the_source(kind, text):
    for head, tail in (("", ""), ("Ñandú é: ", " and then."), ("Mail to <", ">; ")):
        whole = head + text + tail
        found = P.disguised(whole)[kind]
        assert (len(head), len(head) + len(text)) in found, (whole, found)
        assert not any(v for k, v in P.disguised(whole).items() if k != kind)


@pytest.mark.parametrize("text", [
    "Meet me at example.com or at noon.", "We sat at home . The dot was small.", "one two three go", "in one 4845168114407329",
    "Привет, почта ivan@example.ru", "été à la plage · 12 · 14", "look at point dot", "a at b dot c1", "x [at] y",
    "cost 3 @ 4.50 each", "пишитеivan@example.ru", "one two three four five six", "№ 10² · 3½",
])
def test_clean_texts_are_left_alone(text):
    assert not any(P.disguised(text).values())


def test_long_runs_take_little_time():
    began = time.time()
    for unit in ("a", "7", "1.", "a.", "+1", "@", "a@", " dot ", " at ", "one ", "(", "[ ", " ", "-", "о", "​", "aо", "7 "):
        text = unit * (300_000 // len(unit))
        P.detect(text)
        P.disguised(text)
    assert time.time() - began < 60


def test_report_and_mask(spark):
    texts = [None, "", "x@y.z, +1 (017) 555-7713", "ab [at] c.de 4111 1111 1111 1111", "a" * 200_000 + "@b.cd", "j at x dot com"]
    rows = [(i, t, "k", i) for i, t in enumerate(texts)] + [(2, texts[2], "k", 2), (None, texts[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, row int")
    got = P.report(df).collect()
    assert len(got) == len(rows)
    for (i, t, *_), r in zip(rows, got):
        base = plain(t or "")
        assert r.doc_id == i and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(x[3] == kind for x in base) for kind in PATTERNS]
        said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    assert got[3].spans == "email:0:12,card:13:32" and got[5].spans == "email:0:14"
    hidden = P.masked(df)
    assert hidden.columns == df.columns
    assert [r.text for r in hidden.collect()][:4] == [None, "", "<email>, <phone>", "<email> <card>"]
    assert P.report(df.limit(0)).count() == 0 and P.masked(df.limit(0)).count() == 0


def test_given_documents_keep_their_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.report(docs).collect():
        said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in plain(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
