"""Token ids in training order: shards of fixed-stride binary sequences.

The texts' ids run on, document after document with an end token, and are chopped every `stride` ids.
A keyed Feistel network over the next even power of two, walked in cycles until it falls into the
domain, permutes the sequence numbers without a table. Every partition has as many numbers as the largest one
can need, a bound known before any text is encoded (a token has at least one byte), so texts are encoded
once and travel once: range partitions of the permuted numbers become shards, each sorted and written at a
fixed stride. Numbers that no sequence took leave no gaps in the files; running sums of the shards' counts give
every sequence its global slot, and slot s is read by one seek. Files are written under temporary names and committed through a manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bpe, commit_files, cut, default_ranks, stored

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * _MIX[0]
    x ^= x >> np.uint64(31)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(29))


def feistel(index: np.ndarray, domain: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..domain-1, elementwise and without a table."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) * 0x9E3779B97F4A7C15 & (2**64 - 1)) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= np.uint64(domain)).any():  # cycle-walking; fewer than four steps on average
            out[far] = once(out[far])
    return out.astype(np.int64)


INDEX = "shard bigint, name string, temporary string, bytes bigint, position bigint, permuted bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, crc32 bigint"


def write(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", stride: int = 1024, key: int = 20240101, end_id: int = 50256, shard_bytes: int = 32 << 20, vocabulary: str | None = None
) -> DataFrame:
    """Write the shards; returns a row per sequence: slot, shard, position, doc_ids, starts, lengths, crc32.

    A first pass measures the partitions of `docs`; the second fails if one needs more numbers than the largest
    one then (store such a table first). A null text is empty and gives its end token. Repeated rows each give tokens. Only the last sequence of a partition is padded, with
    the end token. Ids are unsigned 16-bit little-endian, or 32-bit if the vocabulary needs it. `crc32` is that of
    the whole stride. An empty table gives no shard.
    """
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    part = narrow.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(size + 1).alias("b"))
    last, widest, total = (int(x or 0) for x in part.agg(F.max("p"), F.max("b"), F.sum("b")).first())
    each = -(-widest // stride)  # numbers of a partition
    domain = (last + 1) * each
    path = vocabulary or default_ranks()
    wide = "<u2" if max(bpe(path).tokens) < 65536 and end_id < 65536 else "<u4"
    unit = np.dtype(wide).itemsize
    shards = max(1, -(-total * unit // (2 * shard_bytes)))  # about two bytes of text a token, at least
    span = max(1, -(-domain // shards))
    end = np.array([end_id], dtype=wide)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        tokens = bpe(path)
        number, end_number = p * each, (p + 1) * each
        held, pieces, filled = [], [], 0

        def emit(sequences: list) -> pa.RecordBatch:
            nonlocal number
            if number + len(sequences) > end_number or p > last:
                raise RuntimeError("a partition grew between the passes; store the table first")
            permuted = feistel(np.arange(number, number + len(sequences)), domain, key)
            number += len(sequences)
            cols = list(zip(*sequences))
            return pa.RecordBatch.from_arrays(
                [pa.array(permuted // span), pa.array(permuted), *(pa.array(c, pa.list_(pa.int64())) for c in cols[:3]), pa.array(cols[3], pa.binary())],
                names=["shard", "permuted", "doc_ids", "starts", "lengths", "ids"],
            )

        done: list = []

        def close() -> None:
            nonlocal held, pieces, filled
            done.append((*map(list, zip(*pieces)), b"".join(held)))
            held, pieces, filled = [], [], 0

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([tokens.ids(t or "").astype(wide), end])
                at = 0
                while at < len(ids):
                    n = min(stride - filled, len(ids) - at)
                    held.append(ids[at : at + n].tobytes())
                    pieces.append((doc, at, n))
                    at, filled = at + n, filled + n
                    if filled == stride:
                        close()
                if len(done) >= 500:
                    yield emit(done)
                    done = []
        if filled:
            close()
        if done:
            yield emit(done)

    made = narrow.mapInArrow(encode, "shard bigint, permuted bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, ids binary")
    made = made.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "permuted")
    pad = end.tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/_temporary", recursive=True)
        attempt, now, stream, position, pending = uuid.uuid4().hex, None, None, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            """The rows of a shard, once its file is closed."""
            stream.close()
            name = f"tokens-{now:06d}.bin"
            tmp = f"_temporary/{name}.{attempt}"
            for k in range(0, len(pending), 5000):
                part = pending[k : k + 5000]
                n = len(part)
                fixed = [pa.array([now] * n), pa.array([name] * n), pa.array([tmp] * n), pa.array([position * stride * unit] * n), pa.array(range(k, k + n), pa.int64())]
                cols = list(zip(*part))
                lists = [pa.array(c, pa.list_(pa.int64())) for c in cols[1:4]]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(cols[0]), *lists, pa.array(cols[4], pa.int64())], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for shard, permuted, docs_, starts, lengths, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if stream is not None:
                        yield from out()
                    now, position, pending = shard, 0, []
                    stream = files.open_output_stream(f"{root}/_temporary/tokens-{now:06d}.bin.{attempt}", compression=None)
                ids += pad * ((stride * unit - len(ids)) // unit)
                stream.write(ids)
                pending.append((permuted, docs_, starts, lengths, zlib.crc32(ids)))
                position += 1
        if stream is not None:
            yield from out()

    index = stored(made.mapInArrow(save, INDEX), "token-index")
    files_ = commit_files(cut(index.groupBy("shard", "name", "temporary", "bytes").agg(F.count("*").alias("sequences"))), folder)
    slots = stored(_slots(files_).select("shard", "name", "sequences", "first_slot", F.lit(stride).cast("bigint").alias("stride"), F.lit(unit).cast("bigint").alias("unit")), "slots")
    slots.write.parquet(f"{folder}/manifest")
    index = index.drop("temporary", "bytes").join(slots.select("shard", "first_slot"), "shard")
    return index.withColumn("slot", F.col("first_slot") + F.col("position")).drop("first_slot")


def _slots(files_: DataFrame, block: int = 1024) -> DataFrame:
    """`files_` with the slot of each shard's first sequence: running sums inside blocks of shards, then over the blocks."""
    parts = files_.withColumn("block", F.expr(f"shard DIV {block}"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("block").agg(F.sum("sequences").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per `block` shards
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    out = parts.withColumn("within", F.coalesce(F.sum("sequences").over(inside), F.lit(0)))
    return out.join(blocks, "block").withColumn("first_slot", F.col("earlier") + F.col("within")).drop("block", "earlier", "within")


READ = "slot bigint, shard bigint, position bigint, crc32 bigint"


def read(spark, folder: str, begin: int = 0, batch: int = 256) -> DataFrame:
    """(slot, shard, position, crc32) of every sequence from slot `begin` on, each shard read in order from one seek."""
    manifest = spark.read.parquet(f"{folder}/manifest").where(F.col("first_slot") + F.col("sequences") > begin)
    tasks = min(max(1, manifest.count()), 10_000)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                width, at = row["stride"] * row["unit"], max(0, begin - row["first_slot"])
                with files.open_input_file(f"{root}/{row['name']}") as f:
                    f.seek(at * width)
                    while data := f.read(batch * width):
                        crcs = [zlib.crc32(data[k : k + width]) for k in range(0, len(data), width)]
                        place = np.arange(at, at + len(crcs))
                        yield pa.RecordBatch.from_arrays([pa.array(row["first_slot"] + place), pa.array([row["shard"]] * len(crcs)), pa.array(place), pa.array(crcs, pa.int64())], names=["slot", "shard", "position", "crc32"])
                        at += len(crcs)

    return manifest.select("shard", "name", "first_slot", "stride", "unit").repartitionById(tasks, F.col("shard").cast("int")).mapInArrow(load, READ)
