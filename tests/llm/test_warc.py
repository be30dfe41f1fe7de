import gzip
import hashlib
import os
import random

import pytest

from newsloom.llm import warc as W


def pages():
    rnd = random.Random(5)
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "http://a/4", "short"), (9, "u", long), (5, "v", long), (7, "w\r\nX: y", long)]
    rows += [(100 + i, f"http://b/{i}", "é" * rnd.randint(1, 400) + f"{rnd.random()}\r\n\r\n") for i in range(300)]
    return rows


def want(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.get(raw, i) != i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)
    return out


@pytest.mark.parametrize("shard_bytes,file_bytes", [(1 << 30, 1 << 30), (20_000, 4_000)])
def test_round_trip_and_determinism(spark, tmp_path, shard_bytes, file_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    hashes = []
    for k in range(2):
        folder = f"file://{tmp_path}/{k}"
        manifest = W.write(df.repartition(3 + k), folder, shard_bytes, file_bytes)
        got = W.read(manifest, folder).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want(rows)
        assert len(got) == len(rows) and all(r.intact for r in got)
        files = sorted(x for x in os.listdir(tmp_path / str(k)) if x.endswith(".warc.gz"))
        assert files == sorted(r.name for r in manifest.collect())
        assert not os.listdir(tmp_path / str(k) / "_temporary")
        hashes.append([hashlib.sha256((tmp_path / str(k) / f).read_bytes()).hexdigest() for f in files])
        keys = [(r.shard, r.part, r.first_key, r.last_key) for r in manifest.orderBy("shard", "part").collect()]
        assert all(a[3] <= b[2] for a, b in zip(keys, keys[1:]))
        assert gzip.open(tmp_path / str(k) / files[0]).read().startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert hashes[0] == hashes[1] and (len(hashes[0]) > 5) == (file_bytes < 10_000)


def test_repeats_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 150)] * 3, "page_id long, url string, html string")
    df = df.unionByName(spark.createDataFrame([(2, "v", "a" * 150)] * 2 + [(None, "w", None)] * 2, df.schema))
    got = W.read(W.write(df, f"file://{tmp_path}/r"), f"file://{tmp_path}/r").collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("1", "response", None)] * 3 + [("2", "revisit", 1)] * 2 + [("None", "response", None)] * 2
    heads = b"".join(gzip.open(tmp_path / "r" / f).read() for f in os.listdir(tmp_path / "r") if f.endswith(".gz")).decode().split("\r\n")
    ids = [x.split(": ", 1)[1] for x in heads if x.startswith("WARC-Record-ID")]
    assert len(set(ids)) == len(ids) == 7 and {x.split(": ", 1)[1] for x in heads if x.startswith("WARC-Refers-To:")} < set(ids)
    none = W.write(df.limit(0), f"file://{tmp_path}/e")
    assert W.read(none, f"file://{tmp_path}/e").collect() == []


def test_null_ids_hot_ids_and_long_payloads(spark, tmp_path):
    rnd = random.Random(7)
    same, huge = "s" * 500, "h" * 3_000_000
    rows = [(None, "u", same), (None, "u", "only here" * 50), (None, None, None), (8, "v", same), (6, "w", same), (9, "x", huge)]
    rows += [(5, "hot", f"{rnd.random()} " * 60) for _ in range(400)]  # a third of all and more under one id
    folder = f"file://{tmp_path}/h"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = W.write(df, folder, 20_000, 50_000)
    got = W.read(manifest, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    twins = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_digest == hashlib.sha256(same.encode()).hexdigest())
    assert twins == [("6", "response", None), ("8", "revisit", 6), ("None", "revisit", 6)]
    assert sum(r.page_id is None and r.record_type == "response" for r in got) == 2
    shards = {r.shard: r.records for r in manifest.groupBy("shard").agg({"records": "sum"}).withColumnRenamed("sum(records)", "records").collect()}
    assert max(shards.values()) < 100  # the hot id is dealt out


def test_urls_stay_different():
    urls = ["http://a/x y", "http://a/xy", "http://a/x\ty", "http://a/x\r\nWARC-Type: y", None]
    assert len({W.target(u) for u in urls}) == 5 and all(not set(W.target(u)) & set(" \r\n\t") for u in urls)
