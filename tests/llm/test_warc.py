"""Round trips, splits anywhere, foreign bytes, and revisits."""

import base64
import gzip
import hashlib
import io
import os
import random

from funnelspark.llm import warc as A

PAGES = "page_id long, url string, html string, payload string"


def expected(rows, min_bytes=0):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        first = min(same, default=None) if len(data) >= min_bytes else None
        other = first is not None and (key is None or first < key)
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    return sorted((tuple(r) for r in A.round_trip(df, **options).collect()), key=repr)


def sample(n=60, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "é" * 50, "WARC/1.1\r\n\r\n", "<p>x</p>" * 3000]
    return [(i * 3, None if rng.random() < 0.1 else f"http://a/{i}\r\n", rng.choice(texts) if rng.random() < 0.5 else "".join(
        chr(rng.randrange(32, 0x2FF)) for _ in range(rng.randrange(0, 900)))) for i in range(n)]


def test_round_trip(spark):
    rows = sample()
    assert run(spark, rows) == expected(rows)


def test_any_split_size_reads_every_record_once(spark):
    rows = sample(40, 2)
    for split in (64, 1000, 10**9):
        assert run(spark, rows, split_bytes=split) == expected(rows)


def test_small_payloads_below_the_bound_are_written_again(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough"), (4, "u", "long enough")]
    assert run(spark, rows, min_bytes=5) == expected(rows, 5)


def test_nulls_and_empty_table(spark):
    rows = [(None, None, "p"), (7, None, "p"), (None, "u", "alone"), (8, "u", None), (9, "u", "")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_archives_are_plain_gzip(spark, tmp_path):
    rows = [(i, "http://a", f"<p>{i}</p>") for i in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(2)
    manifest = A.write_warc(df, f"file://{tmp_path}/w").collect()
    raw = b"".join(gzip.decompress(open(m["archive"].removeprefix("file://"), "rb").read()) for m in manifest)
    assert raw.count(b"WARC/1.1\r\n") == 20 and sum(m["records"] for m in manifest) == 20
    assert sum(m["bytes"] for m in manifest) == sum(os.path.getsize(m["archive"].removeprefix("file://")) for m in manifest)


def test_reader_skips_foreign_bytes_and_false_magic():
    record = gzip.compress(A._record(1, "u", b"body", b"\0" * 20, None))
    other = gzip.compress(b"no record at all")
    cut = gzip.compress(A._record(2, "u", b"lost" * 50, b"\0" * 20, None))[:-30]
    data = b"junk" + A.MAGIC + b"xx" + record + other + A.MAGIC[:2] + record + cut
    for step in (1, 7, 50, len(data)):
        found = [f["warc-record-id"] for s in range(0, len(data), step)
                 for _, f, block in A.records_in(io.BytesIO(data), s, min(len(data), s + step)) if A._payload(block) == b"body"]
        assert found == ["<urn:x-page:1>"] * 2


def test_registered_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    assert sorted((tuple(r) for r in A.op2_warc(spark, sf_dir).collect()), key=repr) == expected(rows)
