"""Deterministic sharded WARC writer and a verifying reader.

Writing takes one pass over the payloads. Range bounds come from a hash sample of the keys, so they
depend on the data alone; the sample has a fixed bound. Rows go to the task of their range and are sorted by
key inside it. A shard is rolled into files by compressed size. Each record is a gzip member of its own with headers
made anew (ids, lengths, SHA-256 digests) from the row. A task writes under a temporary name that
holds its attempt; only what a successful task reported enters the manifest table, and a second
job renames those files. Renaming is repeatable, so either job may lose executors and run again.
The manifest is written last: a reader sees all files or none.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import commit_files, cut, spread_join

MANIFEST = "name string, temporary string, shard bigint, part bigint, records bigint, bytes bigint, sha256 string, first_key bigint, last_key bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, file string, offset bigint, intact boolean"
CRLF = b"\r\n"
#: Most shards of an archive, and sampled keys a shard: at most 16 MB of keys reach the driver, 1 MB of bounds the tasks.
MOST_SHARDS, PER_SHARD = 1 << 16, 16
_BLANK = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def target(url: str | None) -> str:
    """The URL as a header field: blanks and control characters are percent-encoded, so different URLs stay different."""
    return _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def record_id(key: int | None, digest: str, repeat: int) -> str:
    """The id of the `repeat`-th record (from 0) of a page with this payload; a revisit refers to the first of its response."""
    return f"<urn:x-page:{'none' if key is None else key}:{digest}:{repeat}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, repeat: int = 0) -> bytes:
    """One gzip member: a response with the payload, or a revisit with the HTTP head alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest, repeat)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time in the gzip head: equal input gives equal bytes
    return pack.compress(CRLF.join([x.encode() for x in head] + [b"", block]) + CRLF + CRLF) + pack.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, digest, size, refers_to) per row of `pages`, without its payload.

    Of equal payloads of at least `least_bytes`, the least page_id is the response. The rows of a common payload are dealt out.
    """
    small = cut(
        pages.select(
            "page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size")
        )
    )
    first = small.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return spread_join(small, first.drop("n"), "digest", how="left").select("page_id", "url", "digest", "size", seen.alias("refers_to"))


KEY = np.dtype([("page", "<i8"), ("digest", "<i8")])


def keys_of(page: np.ndarray, digest: np.ndarray) -> np.ndarray:
    out = np.empty(len(page), dtype=KEY)
    out["page"], out["digest"] = page, digest
    return out


def _key(page: str, digest: str) -> list:
    """The range key: page_id (null first), then a hash of the payload, which parts pages that share an id."""
    return [F.coalesce(page, F.lit(-(1 << 63))).alias("page"), F.xxhash64(digest).alias("hash")]


def range_bounds(keys: DataFrame, shards: int) -> np.ndarray:
    """Upper bounds of all shards but the last, from a hash sample of about PER_SHARD rows a shard."""
    every = max(1, keys.count() // (shards * PER_SHARD))
    rows = keys.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0).select(*_key("page_id", "digest")).distinct().limit(4 * MOST_SHARDS * PER_SHARD).toPandas()
    if shards < 2 or not len(rows):
        return np.empty(0, dtype=KEY)
    sample = np.sort(keys_of(rows["page"].to_numpy(), rows["hash"].to_numpy()), order=["page", "digest"])
    return np.unique(sample[(np.arange(1, shards) * len(sample)) // shards])


def write(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, file_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive `pages` (page_id, url, html) under `folder`; returns the manifest table.

    A null html is an empty payload. Pages without an id come first; they may refer to another page, but none
    refers to them. Repeated rows give a record each, with an id of its own. An empty table gives an archive without files.
    `shard_bytes` of payload go to a shard (more if there were over MOST_SHARDS of them), about `file_bytes` of
    compressed records to a file.
    """
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url"), F.col("html"))
    marks = cut(with_revisits(base))
    total = marks.agg(F.sum("size")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    bounds = range_bounds(marks, shards)

    @F.pandas_udf("bigint")
    def shard_of(page: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys_of(page.to_numpy(), digest.to_numpy()), side="left"))

    # Payloads travel once. The row that says what a payload refers to goes along as a row of its own,
    # which the sort puts before the payload's.
    twice = marks.groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to")).where("refers_to IS NOT NULL")
    text = F.coalesce("html", F.lit(""))
    marked = twice.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    bodies = base.select("page_id", "url", text.alias("html"), F.sha2(text, 256).alias("digest"), F.lit(None).cast("bigint").alias("refers_to"))
    rows = marked.unionByName(bodies).withColumn("shard", shard_of(*_key("page_id", "digest")))
    rows = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", F.xxhash64("digest"), "digest", F.col("html").isNotNull(), "url")
    fields = rows.columns

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(f"{root}/_temporary", recursive=True)
        attempt, out, now, mark, last, repeat = uuid.uuid4().hex, None, (None, -1), None, None, 0

        def close() -> tuple:
            out["stream"].close()
            return (out["name"], out["tmp"], out["shard"], out["part"], out["n"], out["size"], out["sha"].hexdigest(), out["keys"][0], out["keys"][1])

        def manifest(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=schema)

        names = [x.split()[0] for x in MANIFEST.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("name", "temporary", "sha256") else pa.int64()) for n in names])
        for big in batches:
            for at in range(0, big.num_rows, 256):
                done = []
                batch = big.slice(at, 256)
                for row in zip(*(batch.column(fields.index(f)).to_pylist() for f in ("shard", "page_id", "url", "html", "digest", "refers_to"))):
                    shard, key, url, html, digest, refers = row
                    if html is None:
                        mark = (key, digest, refers)
                        continue
                    refers = mark[2] if mark and mark[:2] == (key, digest) else None
                    repeat = repeat + 1 if last == (key, digest) else 0  # equal rows are neighbours
                    last = (key, digest)
                    raw = record(key, url, html.encode("utf-8", "surrogatepass"), digest, refers, date, repeat)
                    if out is None or out["shard"] != shard or out["size"] + len(raw) > file_bytes:
                        if out is not None:
                            done.append(close())
                        part = now[1] + 1 if now[0] == shard else 0
                        now = (shard, part)
                        name = f"pages-{shard:06d}-{part:06d}.warc.gz"
                        tmp = f"_temporary/{name}.{attempt}"
                        out = {"name": name, "tmp": tmp, "shard": shard, "part": part, "n": 0, "size": 0, "sha": hashlib.sha256(), "keys": [key, key], "stream": files.open_output_stream(f"{root}/{tmp}", compression=None)}
                    out["stream"].write(raw)
                    out["sha"].update(raw)
                    out["n"] += 1
                    out["size"] += len(raw)
                    out["keys"][1] = key
                if done:
                    yield manifest(done)
        if out is not None:
            yield manifest([close()])

    made = cut(rows.mapInArrow(save, MANIFEST))

    committed = commit_files(made, folder)
    committed.write.parquet(f"{folder}/manifest")  # with _SUCCESS, the mark of a whole archive
    return committed


def _members(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a stream, read in blocks."""
    start, pos, pending = 0, 0, b""
    unzip, parts = zlib.decompressobj(31), []
    while True:
        data = pending or stream.read(size)
        pending = b""
        if not data:
            if parts or pos != start:
                raise ValueError("a record is cut off")
            return
        parts.append(unzip.decompress(data))
        pos += len(data) - len(unzip.unused_data)
        if unzip.eof:
            yield start, b"".join(parts)
            pending, start = unzip.unused_data, pos
            unzip, parts = zlib.decompressobj(31), []


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda x: None if x.split(":")[2] == "none" else int(x.split(":")[2])
    whole = rest[len(block) :] == CRLF + CRLF and hashlib.sha256(block).hexdigest() == fields["WARC-Block-Digest"].removeprefix("sha256:")
    if not revisit:
        whole = whole and len(payload) == length and hashlib.sha256(payload).hexdigest() == digest
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "url": fields["WARC-Target-URI"],
        "intact": whole,
    }


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archive's files, digests checked (`intact`)."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, raw in _members(stream):
                        rows.append({**_parse(raw), "file": name, "offset": offset})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = min(max(1, manifest.count()), 10_000)
    return manifest.select("name").repartition(tasks, "name").mapInArrow(load, RECORDS)
