"""WARC archives: round trips, index lookups against a plain scan, and damaged or odd pages."""

import gzip
import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.llm import warc

SCHEMA = "page_id bigint, url string, html string, kind string, file int"


def pages(seed, n=400):
    rng = np.random.default_rng(seed)
    hosts, bodies = ["a.example.com", "b.example.com", "example.net", "EXAMPLE.org:8080"], ["", None, "<p>same</p>", "<p>é\r\n\r\nWARC/1.1</p>"]
    rows = []
    for i in range(n):
        url = [f"https://{hosts[rng.integers(4)]}/p/{rng.integers(30)}?x={rng.integers(3)}", "http://hot.example/", None, "", "no host", "http://[bad", " http://sp ace/\n"][0 if rng.random() < 0.5 else rng.integers(1, 7)]
        body = bodies[rng.integers(4)] if rng.random() < 0.4 else f"<p>{rng.integers(1000)}</p>" * 5
        rows.append((int(rng.integers(0, n)) if rng.random() > 0.03 else None, url, body, "k", 3))
    return rows + rows[:20] + [rows[0]] * 30


def expected(rows):
    by = defaultdict(list)
    for i, u, h, *_ in rows:
        by[h or ""].append(i)
    out = Counter()
    for body, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = warc.digest32(hashlib.sha1(body.encode()).digest())
        out[ids[0], len(body.encode()), digest, "response", None] += 1
        for i in ids[1:]:
            out[i, len(body.encode()), digest, "revisit", ids[0]] += 1
    return out


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_REPEATED", broadcast)
    rows = pages(broadcast)
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert Counter(map(tuple, got.collect())) == expected(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_reads_only_named_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 40}.example.com/{i // 80}", f"body {i}", "", 0) for i in range(400)] + [(1000 + i, "http://hot.example.com/", f"hot {i}", "", 0) for i in range(100)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder, ix = warc.archive(table)
    asked = spark.createDataFrame([("http://h7.example.com/0",), ("http://hot.example.com/",), ("http://hot.example.com/",), ("http://none.example.com/",), (None,)], "url string")
    captures = warc.lookup(ix, warc.keys_of(asked, F.col("url")))
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.records(captures).collect()}
    assert got == {i: h for i, u, h, *_ in rows if u in ("http://h7.example.com/0", "http://hot.example.com/")}
    keys = [b for r in ix.bounds for b in r[:2]]
    assert keys == sorted(keys) and warc.lookup(ix, asked.select(F.lit("").alias("key"))).count() == 0
    # any reader of WARC files can read them: gzip members, one a record
    local = folder.removeprefix("file:")
    text = b"".join(gzip.open(f"{local}/{f}").read() for f in os.listdir(local) if f.endswith(".warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 500


def test_damage_is_told(tmp_path):
    raw = warc.record(1, "http://x/", b"abc", 3, warc.digest32(hashlib.sha1(b"abc").digest()), "response", (None, None))
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="ends"):
        warc.parse(raw[:-3])


def test_keys():
    assert warc.surt("https://www.Example.com/a?b#c") == "com,example,www)/a?b#c" and warc.surt("http://x.org:81") == "org,x:81)/"
    assert [warc.surt(u) for u in (None, "", "x y", "http://[bad")] == ["", "", "x y", "http://[bad"]
    assert warc.surt("http://user@h.net?q=://") == "net,h)?q=://"


def test_ranges_join_neighbours(tmp_path):
    data = os.urandom(300_000)
    (tmp_path / "f").write_bytes(data)
    places = [(0, 5), (3, 10), (100, 1), (200_000, 50), (299_999, 1)]
    assert list(warc.ranges(str(tmp_path / "f"), places)) == [data[o : o + n] for o, n in places]
