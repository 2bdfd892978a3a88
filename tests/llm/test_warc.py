"""WARC archives: exact round trip, framing and damage."""

import gzip
import hashlib
import io

import pytest

from cohortlens.llm import warc

ROWS = [(3, "http://a/", "x" * 200), (1, "http://b/\r\nX: y", "x" * 200), (2, None, "short"), (4, "u", "short"), (None, "n", "x" * 200),
        (7, "e", ""), (8, "e", None), (9, "é ü", "ß\r\n\r\nWARC/1.1\r\n" + "é" * 70000), (9, "é ü", "ß\r\n\r\nWARC/1.1\r\n" + "é" * 70000),
        (10, "z", "y" * 3_000_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(df, archive_bytes=300).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        least = min((j for j, _, g in ROWS if g == h and j is not None), default=None)
        again = len(p) >= 100 and least is not None and (i is None or i > least)
        want.append((i or -1, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least if again else None))
    key = lambda r: str(r)
    assert sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_survive(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path / "w"))
    back = {(r.page_id, r.payload) for r in warc.read_archives(manifest, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert {(9, ROWS[7][2].encode()), (1, b"x" * 200), (7, b""), (8, b"")} <= {(i, bytes(p)) for i, p in back}


def _one(payload=b"hello"):
    return warc.record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None, False)


def test_members_one_by_one():
    data = _one() + _one(b"q" * 200000) + _one(b"")
    records = list(warc.read_records(io.BytesIO(data)))
    assert [warc.parsed(*r)["payload"] for r in records] == [b"hello", b"q" * 200000, b""]
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in (_one(), _one(b"")))


@pytest.mark.parametrize("data", [
    _one()[:-9], _one() + _one()[:40], gzip.compress(b"no header"), gzip.compress(gzip.decompress(_one())[:-4]),
    gzip.compress(gzip.decompress(_one()) + b"more"), gzip.compress(gzip.decompress(_one()).replace(b"hello", b"jello"))])
def test_damage_is_refused(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))
