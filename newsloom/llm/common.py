"""Shared helpers: column-appending Arrow maps, checkpoints and cached byte-level BPE.

Conventions of every operator in this subpackage:

* a null text is an empty text unless an operator says otherwise;
* input frames may carry any other columns; operators read only those that they name and
  give their own columns names that do not clash;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import base64
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the setting is absent and all tasks run on this machine (tests) a temporary folder is made; on a
    cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(sc, "_newsloom_shared", None)
        if not base:
            base = sc._newsloom_shared = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as compressed Parquet in the shared folder and read it back (for wide rows)."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, one: DataFrame, key: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """`many` joined on `key` with `one`, which holds each key once at most: the rows of a key go to `salts` tasks.

    `many` is dealt by a hash of its whole rows, and `one`, narrow as it is, goes to each salt.
    """
    salt = free_name([*many.columns, *one.columns], "_salt")
    left = many.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.lit(salts)).cast("int"))
    right = one.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts)))))
    return left.join(right, [key, salt], how).drop(salt)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores appended until no taken column equals it (case ignored)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def by_ids(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of `df` with the one column of `ids`, whatever else `df` holds."""
    name = free_name(df.columns, "_ids")
    return df.join(ids.toDF(name).distinct(), F.col(key) == F.col(name), how)


def append_columns(
    df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], kernel: Callable[[list], list], rows: int = 512
) -> tuple[DataFrame, list[str]]:
    """Append columns computed from one text column by an Arrow-batched kernel; no shuffle.

    `kernel` takes a list of texts (None allowed) and returns one sequence per field. Batches
    go to it in slices of `rows`, so memory is bounded by a slice, not by a partition.
    Returns the frame and the names used (underscores are added on a clash).
    """
    names = []
    for wanted, _ in fields:
        names.append(free_name([*df.columns, *names], wanted))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, (_, t) in zip(names, fields))])
    arrow = to_arrow_schema(schema)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, rows):
                batch = big.slice(start, rows)
                made = kernel(batch.column(at).to_pylist())
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, arrow)]
                columns += [pa.array(x, type=f.type) for x, f in zip(made, list(arrow)[len(columns) :])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema), names


# ---------------------------------------------------------------- byte-level BPE with a cache

#: Before a space that follows a blank and precedes a blank or the end, cutting could change pre-tokens.
_UNSAFE = re.compile(r"\s (?:\s|$)")


class CachedBpe:
    """Exact byte-level BPE over whole texts, cached by chunk.

    The vocabulary's pre-tokeniser never joins a non-blank with a following space, so a text may
    be cut before every space that follows a non-blank (or follows a blank and precedes a
    non-blank) without changing its tokens. Chunks repeat, so each distinct chunk is encoded once
    per worker until the cache holds `limit` chunks and is emptied. Other texts are encoded whole.
    """

    def __init__(self, ranks_path: str, limit: int = 500_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.tokens = {v: k for k, v in ranks.items()}
        self._cache: dict[str, bytes] = {}
        self._limit = limit

    def ids(self, text: str) -> np.ndarray:
        """Token ids as unsigned 32-bit little-endian numbers."""
        return np.frombuffer(self.raw(text), dtype="<u4")

    def raw(self, text: str) -> bytes:
        if not text:
            return b""
        if len(text) > 1 and _UNSAFE.search(text):
            return np.array(self._encode(text), dtype="<u4").tobytes()
        cache = self._cache
        if len(cache) > self._limit:
            cache.clear()
        first, *rest = text.split(" ")
        chunks = [" " + x for x in rest]
        if first:
            chunks.insert(0, first)
        get, out = cache.get, []
        for c in chunks:
            x = get(c)
            if x is None:
                x = cache[c] = array("I", self._encode(c)).tobytes()
            out.append(x)
        return b"".join(out)


#: Caches of a worker process; Spark keeps workers from stage to stage.
CACHES: list[dict] = []


def release(but: dict | None = None) -> None:
    """Drop what earlier stages left in this worker's caches."""
    for cache in CACHES:
        if cache is not but and cache:
            cache.clear()


_BPE: dict[str, CachedBpe] = {}
CACHES.append(_BPE)


def bpe(path: str) -> CachedBpe:
    """One cached tokeniser per worker process and vocabulary."""
    if path not in _BPE:
        _BPE[path] = CachedBpe(path)
    return _BPE[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def commit_files(made: DataFrame, folder: str) -> DataFrame:
    """Rename the files that `made` (name, temporary, bytes, ...) reports and return its rows without `temporary`.

    Renaming again what is already renamed does nothing, so lost tasks may run again.
    """
    schema = made.schema

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.select(["name", "temporary", "bytes"]).to_pylist():
                old, new = files.get_file_info([f"{root}/{row['temporary']}", f"{root}/{row['name']}"])
                if old.type == fs.FileType.File:
                    files.move(old.path, new.path)
                elif new.type != fs.FileType.File or new.size != row["bytes"]:
                    raise OSError(f"{row['name']} is lost")
            yield batch

    return cut(made.mapInArrow(commit, schema)).drop("temporary")
