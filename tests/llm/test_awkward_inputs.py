"""Rows without ids in line dedup, foreign archives, and one-sided labels of findings."""

import base64
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gradewalk.llm import lines, secrets, warc
from gradewalk.llm.common import save

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_line_lists_stay_as_long_as_their_texts(spark):
    """Many rows without an id, all of lines that other documents have: each is sent its own lines only."""
    n = 20_000
    line = lambda k: F.concat(F.lit("a common line, number "), k.cast("string"))
    every = spark.range(500).select(F.col("id").alias("doc_id"), line(F.col("id")).alias("text"))
    lost = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws("\n", line(F.col("id") % 500), F.concat(F.lit("own line of "), F.col("id").cast("string")), line(F.col("id") * 7 % 500)).alias("text"))
    docs = save(every.unionAll(lost))
    told = lines.drops(docs)
    assert told.agg(F.max(F.size("keys"))).first()[0] == 2 and told.count() == n
    cleaned = lines.dedup_lines(docs).filter("doc_id IS NULL")
    assert cleaned.filter("NOT startswith(text, 'own line of ') OR contains(text, '\n')").count() == 0 and cleaned.distinct().count() == n


def _member(kind, block, headers=(), content="application/http; msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + c.flush()


def test_foreign_archives_are_read(spark, tmp_path):
    rnd = random.Random(4)
    body = bytes(rnd.randrange(32, 127) for _ in range(3_000))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    sha256 = hashlib.sha256(body).hexdigest()
    parts = [
        _member("warcinfo", b"software: some crawler\r\n", ["WARC-Record-ID: <urn:a>"], "application/warc-fields"),
        _member("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", ["WARC-Record-ID: <urn:b>"], "application/http; msgtype=request"),
        _member("response", http + body, ["WARC-Record-ID: <urn:c>", f"WARC-Payload-Digest: sha1:{b32}", "WARC-Target-URI: http://x/"]),
        _member("response", http + body, ["WARC-Record-ID: <urn:d>"]),
        _member("response", http + body, ["WARC-Record-ID: <urn:e>", f"WARC-Payload-Digest: sha256:{sha256}"]),
        _member("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", ["WARC-Record-ID: <urn:f>", f"WARC-Payload-Digest: sha1:{b32}"]),
        _member("revisit", http, ["WARC-Record-ID: <urn:g>", "WARC-Refers-To: <urn:c>", f"WARC-Payload-Digest: sha1:{b32}"]),
        _member("metadata", b"fetchTimeMs: 12\r\n", (), "application/warc-fields"),
        _member("response", http + body, ["WARC-Record-ID: <urn:h>", "WARC-Payload-Digest: other:zzz"]),
    ]
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(parts))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    for split in (1 << 20, 1_000):
        got = {r["record_id"]: r for r in warc.read(manifest, f"file://{tmp_path}", split).collect()}
        assert len(got) == len(parts) and got[None]["record_type"] == "metadata" and bytes(got["<urn:a>"]["payload"]) == b"software: some crawler\r\n"
        assert all(bytes(got[f"<urn:{k}>"]["payload"]) == body and got[f"<urn:{k}>"]["digest"] == hashlib.sha1(body).hexdigest() for k in "cdeh")
        assert got["<urn:g>"]["payload"] is got["<urn:g>"]["payload_bytes"] is None and got["<urn:g>"]["digest"] == hashlib.sha1(body).hexdigest()
        assert got["<urn:f>"]["payload_bytes"] == 13 and got["<urn:c>"]["uri"] == "http://x/"
    path.write_bytes(_member("response", http + body, [f"WARC-Payload-Digest: sha1:{'0' * 40}"]))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long"), f"file://{tmp_path}").collect()


def test_findings_are_sampled_in_any_order_and_of_both_kinds():
    found = sorted(secrets.labelled_findings(12_000), key=lambda f: f[4])
    few = secrets.sample(found)
    assert len(few) == secrets.LABELLED_MOST and sum(f[4] for f in few) == secrets.LABELLED_MOST // 2
    assert sorted(few) == sorted(secrets.sample(found[::-1]))
    rare = [f for f in found if f[4]][:100] + [f for f in found if not f[4]]
    assert sum(f[4] for f in secrets.sample(rare)) == 100 and len(secrets.sample(rare)) == secrets.LABELLED_MOST


def test_findings_of_one_kind(spark):
    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123456789abcdef01234567"'), (2, None)], "doc_id long, text string")
    for label, n in ((1, 1), (0, 0)):
        model = secrets.train(spark, VOCABULARY, [f for f in secrets.labelled_findings(400) if f[4] == label])
        assert secrets.scan(docs, model, VOCABULARY).count() == n


def test_kinds_of_secrets_that_no_label_shows(spark):
    """The forest is held against kinds of secrets none of which it was trained on.

    Hexadecimal secrets are the exception (README): without labelled ones the forest takes them for digests."""
    kind = lambda v: "key id" if v.upper().startswith("AKIA") else "hex" if set(v.lower()) <= set("0123456789abcdef") else "letters"
    found = secrets.labelled_findings(6_000, 3)
    for held, least in (("key id", 0.7), ("letters", 0.7), ("hex", 0.0)):
        model = secrets.train(spark, VOCABULARY, [f for f in found if not (f[4] and kind(f[0]) == held)])
        fresh = [f for f in secrets.labelled_findings(3_000, 9) if f[4] and kind(f[0]) == held][:300]
        texts = [(k, f"{b}{v}{a}") for k, (v, b, a, _, _) in enumerate(fresh)]
        got = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), model, VOCABULARY)
        share = got.select("doc_id").distinct().count() / len(texts)
        print(f"{held}: {share:.3f} of {len(texts)} found")
        assert share >= least, held
