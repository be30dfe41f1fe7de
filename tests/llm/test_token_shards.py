import os

import numpy as np
import pytest

from newsloom.llm import token_shards as K
from newsloom.llm.common import bpe, default_ranks


@pytest.mark.parametrize("domain", [1, 2, 3, 7, 64, 1000, 5000, 65537])
def test_feistel_is_a_keyed_permutation(domain):
    a, b = (K.feistel(np.arange(domain), domain, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(domain)) and (domain < 20 or (a != b).mean() > 0.9)


def docs():
    rows = [(1, None), (2, ""), (3, "word " * 3000)]
    return rows + [(i, f"document {i} says " + "hello world " * (i % 37)) for i in range(4, 400)] + [(4, "again")]


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    spark.createDataFrame([(*r, 1, "x") for r in docs()], "doc_id long, text string, shard int, ids string").repartition(3).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    index = K.write(df, folder, stride=64, shard_bytes=4096).collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n)) and len({r.shard for r in index}) > 3
    got = {r.slot: (r.shard, r.position, r.crc32) for r in K.read(spark, folder).collect()}
    assert got == {r.slot: (r.shard, r.position, r.crc32) for r in index}
    assert sorted(r.slot for r in K.read(spark, folder, begin=n // 2).collect()) == list(range(n // 2, n))
    raw = {r.shard: np.fromfile(f"{tmp_path}/s/{r.name}", dtype="<u2").reshape(-1, 64) for r in index}
    assert sum(map(len, raw.values())) == n and not os.listdir(f"{tmp_path}/s/_temporary")
    pieces = {}
    for r in index:
        at = 0
        for d, s, length in zip(r.doc_ids, r.starts, r.lengths):
            pieces.setdefault((d, s), []).append(raw[r.shard][r.position][at : at + length])
            at += length
        assert (raw[r.shard][r.position][at:] == 50256).all()
    tokens = bpe(default_ranks())
    for d in {r[0] for r in docs()} - {4}:
        own = sorted((s, p) for (k, s), ps in pieces.items() if k == d for p in ps)
        text = dict(docs())[d]
        assert np.concatenate([p for _, p in own]).tolist() == [*tokens.ids(text or "").tolist(), 50256]
    assert sum(len(p) for ps in pieces.values() for p in ps) == sum(len(tokens.ids(t or "")) + 1 for _, t in docs())


def test_order_is_shuffled_and_repeatable(spark, tmp_path):
    spark.createDataFrame(docs(), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    runs = [sorted((r.slot, r.crc32) for r in K.write(df, f"file://{tmp_path}/{k}", stride=64, key=k // 2).collect()) for k in range(3)]
    assert runs[0] == runs[1] != runs[2]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.write(df, f"file://{tmp_path}/e").collect() == []
    assert K.read(spark, f"file://{tmp_path}/e").collect() == []


def test_slots_run_on_over_blocks_of_shards(spark):
    files = spark.createDataFrame([(s, s % 5 + 1) for s in range(0, 90, 2)], "shard long, sequences long").repartition(4)
    got, at = sorted((r.shard, r.sequences, r.first_slot) for r in K._slots(files, block=7).collect()), 0
    for _, n, first in got:
        assert first == at
        at += n


def test_null_ids_repeated_rows_and_skewed_partitions(spark, tmp_path):
    rows = [(None, "no id here"), (None, "no id here"), (1, "x " * 20_000), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    index = K.write(spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/s", stride=64, shard_bytes=2048).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    held = [d for r in index for d in r.doc_ids]
    assert held.count(None) >= 2 and {1, 2} <= set(held)
    n = sum(len(bpe(default_ranks()).ids(t or "")) + 1 for _, t in rows)
    assert sum(sum(r.lengths) for r in index) == n
