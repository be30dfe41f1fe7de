"""Token counts that follow edits: a segment tree over pre-token blocks per document.

A leaf covers a run of text between two places where no pre-token can cross: before a space that
follows a non-blank. Leaves hold characters and tokens, inner nodes their sums. An edit re-encodes the
leaves that it touches, plus neighbours for as long as the border to them is no such place any more, and updates the sums
on the paths to the root.

Trees are kept: `plant` encodes a table of texts once and gives a table of trees, one per document and version
(digest of its text). `apply_edits` takes the edited documents alone, meets their trees, encodes what the edits touch and
gives the new texts with their trees; `renewed` puts these into the table for the next pass. Documents without
edits are answered from their trees, and their texts are neither shuffled nor encoded again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import append_columns, bpe, default_ranks

LEAF_CHARS = 512
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("replacement", T.StringType())]))


def border(text: str, at: int) -> bool:
    """May a leaf begin at `at`?"""
    return 0 < at < len(text) and text[at] == " " and not text[at - 1].isspace()


@dataclass
class Tree:
    """Heaps of sums: node 1 is the root, leaf i is node `width + i`."""

    width: int
    chars: np.ndarray
    tokens: np.ndarray

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def packed(self) -> bytes:
        return np.concatenate([[self.width], self.chars, self.tokens]).astype("<u4").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        raw = np.frombuffer(data, dtype="<u4").astype(np.int64)
        width = int(raw[0])
        return Tree(width, raw[1 : 1 + 2 * width].copy(), raw[1 + 2 * width :].copy())

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one with text for the end), and where it begins."""
        node, begin = 1, 0
        at = max(0, min(at, int(self.chars[1]) - 1))
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin


def build(text: str, encode) -> Tree:
    starts = [0]
    at = LEAF_CHARS
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if border(text, at):
            starts.append(at)
            at += LEAF_CHARS
        else:
            at += 1
    width = 1
    while width < len(starts):
        width *= 2
    chars, tokens = np.zeros(2 * width, dtype=np.int64), np.zeros(2 * width, dtype=np.int64)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        chars[width + i], tokens[width + i] = b - a, len(encode(text[a:b])) // 4
    for node in range(width - 1, 0, -1):
        chars[node] = chars[2 * node] + chars[2 * node + 1]
        tokens[node] = tokens[2 * node] + tokens[2 * node + 1]
    return Tree(width, chars, tokens)


def edit(text: str, tree: Tree, start: int, stop: int, replacement: str, encode) -> tuple[str, int]:
    """Replace text[start:stop] and bring the tree up to date; returns the new text and the characters encoded again.

    A span is cut to the text; one that ends before it begins is empty at its begin.
    """
    n = len(text)
    start = max(0, min(start, n))
    stop = max(start, min(stop, n))
    first, a = tree.leaf_at(start)
    last, b0 = tree.leaf_at(max(start, stop - 1))
    b = b0 + int(tree.chars[tree.width + last])
    new = text[:start] + replacement + text[stop:]
    grown = len(replacement) - (stop - start)
    # A border stays one if the space behind it and the character before it are still of their kinds.
    while a > 0 and not border(new, a):
        first, a = tree.leaf_at(a - 1)
    while b < n and not border(new, b + grown):
        last, b0 = tree.leaf_at(b)
        b = b0 + int(tree.chars[tree.width + last])
    tree.set(first, b + grown - a, len(encode(new[a : b + grown])) // 4)
    for leaf in range(first + 1, last + 1):
        tree.set(leaf, 0, 0)
    return new, b + grown - a


def edit_batch(text: str, tree: Tree, edits: list[tuple[int, int, str]], encode) -> tuple[str, int]:
    """As `edit` for each of many disjoint spans in rising order, all in places of the old text; a leaf is encoded at most once."""
    n, width = len(text), tree.width
    old = tree.chars[width:]
    full = np.flatnonzero(old)  # leaves with text
    begin = (np.cumsum(old) - old)[full]
    starts, stops = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
    grown = np.cumsum([0, *(len(r) - (b - a) for a, b, r in edits)])
    pieces, at = [], 0
    for a, b, r in edits:
        pieces += [text[at:a], r]
        at = b
    new = "".join([*pieces, text[at:]])
    if not len(full):
        tree.set(0, len(new), len(encode(new)) // 4)
        return new, len(new)
    place = begin + grown[np.searchsorted(starts, begin, side="left")]  # of a leaf's begin in the new text
    low = np.searchsorted(begin, np.minimum(starts, n - 1), side="right") - 1
    high = np.searchsorted(begin, np.minimum(np.maximum(starts, stops - 1), n - 1), side="right") - 1
    touched, joined = np.zeros(len(full) + 1, dtype=bool), np.zeros(len(full) + 1, dtype=bool)  # joined: to the leaf before
    for a, b in zip(low, high):
        touched[a : b + 1] = True
        joined[a + 1 : b + 1] = True
    for i in np.flatnonzero(touched[1:-1] | touched[:-2]) + 1:
        if not joined[i] and not border(new, int(place[i])):
            joined[i] = True
    heads = np.flatnonzero(~joined[:-1])
    again = 0
    for i, j in zip(heads, [*heads[1:], len(full)]):
        if j - i == 1 and not touched[i]:
            continue
        a = int(place[i]) if i else 0
        b = int(place[j]) if j < len(full) else len(new)
        again += b - a
        tree.set(int(full[i]), b - a, len(encode(new[a:b])) // 4)
        for k in range(i + 1, j):
            tree.set(int(full[k]), 0, 0)
    return new, again


def apply(text: str, tree: Tree, edits: list[tuple[int, int, str]], encode) -> tuple[str, int]:
    """The new text and the characters encoded again; edits run in order, each on what the last one left, and the tree follows.

    Disjoint edits from the last place to the first, as scrubbing gives them, are the same as one batch.
    """
    n, again = len(text), 0
    if edits and all(0 <= a <= b <= n for a, b, _ in edits) and all(x[0] >= y[1] and x[0] > y[0] for x, y in zip(edits, edits[1:])):
        return edit_batch(text, tree, edits[::-1], encode)
    for start, stop, replacement in edits:
        text, touched = edit(text, tree, start, stop, replacement, encode)
        again += touched
    return text, again


#: Fixed patterns of what a cleaning edit takes out: addresses of mail and hosts, keys, runs of marks. Each with
#: a cheap pattern without which it cannot match.
SCRUB = [
    (re.compile("@"), re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), "<mail>"),
    (re.compile(r"\d\.\d"), re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<host>"),
    (re.compile(r"[0-9a-f]{32}"), re.compile(r"\b[0-9a-f]{32,}\b"), "<key>"),
    (re.compile(r"##|\*\*|\$\$|%%|&&|\|\||!!"), re.compile(r"([#*$%&|!])\1+"), ""),
]


def scrub_edits(text: str | None) -> list[dict]:
    """The edits that clean a text, last place first, so that earlier places stay valid."""
    text = text or ""
    found = [(m.start(), m.end(), r) for quick, p, r in SCRUB if quick.search(text) for m in p.finditer(text)]
    out, free = [], len(text) + 1
    for start, stop, r in sorted(found, key=lambda x: (-x[1], -x[0])):
        if stop <= free:
            out.append({"start": start, "stop": stop, "replacement": r})
            free = start
    return out


FIELDS = ["tokens_before", "tokens_after", "chars_before", "chars_after", "n_edits", "chars_encoded"]
TREES = "doc_id {id}, version string, tree binary, tokens bigint, chars bigint"
UPDATES = "doc_id {id}, version string, text string, new_version string, tree binary, " + ", ".join(f"{f} bigint" for f in FIELDS)


def _version(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.version == b.version)


def plant(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, version, tree, tokens, chars) of every row; each whole text is encoded once. A null text is empty."""
    path = vocabulary or default_ranks()
    out = docs.select(F.col(doc_id).alias("doc_id"), _version(F.col(text)).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(path).raw
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                trees = [build(t, encode) for t in batch.column(2).to_pylist()]
                made = [pa.array([t.packed() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64()), pa.array([int(t.chars[1]) for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "version", "tree", "tokens", "chars"])

    return out.mapInArrow(run, TREES.format(id=out.schema["doc_id"].dataType.simpleString()))


def apply_edits(edited: DataFrame, trees: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """A row of UPDATES for every distinct edited version: its new text and tree, counts before and after, characters encoded.

    `edited` holds the documents to be edited, with an array of (start, stop, replacement) in characters each,
    applied in order; null edits are none, a null replacement is empty, a null text is empty. A version without a
    tree in `trees` gives no row. Rows that repeat a version count once, with the first edits in order of their text form.
    """
    path = vocabulary or default_ranks()
    todo = edited.select(F.col(doc_id).alias("doc_id"), _version(F.col(text)).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(edits).alias("edits"))
    todo = todo.groupBy("doc_id", "version").agg(F.first("text").alias("text"), F.min_by("edits", F.to_json("edits")).alias("edits"))
    known = trees.groupBy("doc_id", "version").agg(F.first("tree").alias("tree"))
    both = todo.join(known, _same(todo, known)).select(todo.doc_id, todo.version, "text", "tree", "edits")
    names = ["doc_id", "version", "text", "new_version", "tree", *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(path).raw
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                rows = []
                for t, packed, todo in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    tree = Tree.unpacked(packed)
                    todo = [(e["start"] or 0, e["stop"] or 0, e["replacement"] or "") for e in todo or [] if e]
                    before = tree.total
                    new, again = apply(t, tree, todo, encode)
                    digest = hashlib.md5(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((new, digest, tree.packed(), before, tree.total, len(t), len(new), len(todo), again))
                types = [pa.string(), pa.string(), pa.binary(), *[pa.int64()] * len(FIELDS)]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return both.mapInArrow(run, UPDATES.format(id=both.schema["doc_id"].dataType.simpleString()))


def renewed(trees: DataFrame, updates: DataFrame) -> DataFrame:
    """`trees` with the versions that `updates` replaced, for the next pass of edits."""
    new = updates.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "new_version", F.col("tree").alias("t"), "tokens_after", "chars_after")
    out = trees.join(new, trees.doc_id.eqNullSafe(new.d) & (trees.version == new.v), "left")
    return out.select(
        "doc_id",
        F.coalesce("new_version", "version").alias("version"),
        F.coalesce("t", "tree").alias("tree"),
        F.coalesce("tokens_after", "tokens").alias("tokens"),
        F.coalesce("chars_after", "chars").alias("chars"),
    )


def counts_after(trees: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc_id, *FIELDS) of every row of `trees`: from the update of its version, else from its tree alone."""
    new = updates.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), *(F.col(f).alias(f"new_{f}") for f in FIELDS))
    out = trees.select("doc_id", "version", "tokens", "chars")
    out = out.join(new, out.doc_id.eqNullSafe(new.d) & (out.version == new.v), "left")
    old = ["tokens", "tokens", "chars", "chars", None, None]
    return out.select("doc_id", *(F.coalesce(f"new_{f}", F.col(o) if o else F.lit(0)).cast("bigint").alias(f) for f, o in zip(FIELDS, old)))


def with_scrub_edits(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with the cleaning edits of each text, and that column's name; a null text has none."""
    out, (name,) = append_columns(docs, text, [("edits", EDITS)], lambda texts: [[scrub_edits(t) for t in texts]])
    return out, name
