"""A quality classifier from trusted positives and unlabelled web text.

Texts become figures of their form (lengths, case, marks, repetition) and shares of hashed word shapes and words, all
over the whole text and of fixed number. A linear model minimises the non-negative unbiased risk

    prior * mean over P of l(f) + max(0, mean over U of l(-f) - prior * mean over P of l(-f))

with the logistic loss l: P are the trusted positives, U any texts, and the difference stands for the risk on the
unseen negatives. Where it falls below zero on a batch the step goes back up, so the model can not overfit it. The class prior
is estimated from P and U alone: a first model tells them apart, and in the range of scores that holds the surest
positives U has about `prior` times the share that P has (the best such range within confidence bounds).

Labels other than 1 are never used. Training rows are bounded samples of fixed-size vectors.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import CACHES, append_columns, by_ids

#: Bounds of the training sample: trusted positives, unlabelled texts.
POSITIVES, UNLABELLED = 4000, 8000
FOLDS, THRESHOLD = 5, 0.3
SHAPES, WORDS = 256, 512
#: Of each text: figures of its words, and of its lines.
PER_WORD = ("chars", "upper", "digits", "marks", "symbols", "beyond", "shouted", "numbered", "marked")
FORM = (*PER_WORD, "n_words", "chars_2", "again", "pairs_again", "distinct", "lines", "same_lines", "ends")
#: Figures of form count as they are and by their roots, which tell small shares apart.
SIZE = 2 * len(FORM) + SHAPES + WORDS
_MARKS = frozenset(b".,;:!?'\"()-")
_KIND = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else ord("u") if c >= 128 else c for c in range(256)
)  # a letter stands for its class


def _shape(word: bytes) -> bytes:
    """Classes of characters, runs of a class as one."""
    out, last = bytearray(), -1
    for c in word.translate(_KIND):
        if c != last:
            out.append(c)
            last = c
    return bytes(out)


class Lexicon(dict):
    """Numbers words; `facts` holds the figures, the shape bucket and the word bucket of each."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self._facts = np.zeros((1024, len(PER_WORD) + 2), dtype=np.float32)
        self._known = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.words.append(word)
        return n

    def facts(self) -> np.ndarray:
        n = len(self)
        if n > len(self._facts):
            self._facts = np.concatenate([self._facts, np.zeros((max(n, len(self._facts)), self._facts.shape[1]), dtype=np.float32)])
        for k in range(self._known, n):
            word = self.words[k]
            kinds = word.translate(_KIND)
            upper, lower, digits = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"0")
            tail = sum(128 <= c < 192 for c in word)  # further bytes of a character
            beyond = kinds.count(b"u") - tail
            chars = len(word) - tail
            marks = sum(map(word.count, _MARKS_LIST))
            symbols = chars - upper - lower - digits - beyond - marks
            bare = word.strip(b".,;:!?'\"()-").lower()
            self._facts[k] = (
                chars, upper, digits, marks, symbols, beyond, upper > 1 and not lower, digits > 0, symbols > 0,
                zlib.crc32(_shape(word)) % SHAPES, zlib.crc32(bare) % WORDS,
            )
        self._known = n
        return self._facts[:n]


_MARKS_LIST = [bytes([c]) for c in sorted(_MARKS)]


def figures(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """A row of SIZE figures per whole text; a null text is empty."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    total, docs = int(lengths.sum()), len(texts)
    ids = np.fromiter((lexicon[w] for x in split for w in x), dtype=np.int64, count=total)
    facts, doc = lexicon.facts(), np.repeat(np.arange(docs), lengths)
    out = np.zeros((docs, SIZE), dtype=np.float32)
    n = np.maximum(lengths, 1)
    of = facts[ids]
    for k in range(len(PER_WORD)):
        out[:, k] = np.bincount(doc, weights=of[:, k], minlength=docs) / n
    at = len(PER_WORD)
    out[:, at] = np.log1p(lengths)
    out[:, at + 1] = np.sqrt(np.bincount(doc, weights=of[:, 0] ** 2, minlength=docs) / n)
    if total > 1:
        inside = doc[1:] == doc[:-1]
        out[:, at + 2] = np.bincount(doc[1:][inside & (ids[1:] == ids[:-1])], minlength=docs) / n
        pairs = np.unique((doc[1:][inside] << 40) | ((ids[:-1] * 1_000_003 + ids[1:])[inside] & ((1 << 40) - 1))) >> 40
        out[:, at + 3] = 1 - (np.bincount(pairs, minlength=docs) + 1) / n
    out[:, at + 4] = np.bincount(np.unique((doc << 32) | ids) >> 32, minlength=docs) / np.sqrt(n)
    for k, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip()]
        if lines:
            out[k, at + 5] = np.log1p(len(lines))
            out[k, at + 6] = 1 - len(set(lines)) / len(lines)
            out[k, at + 7] = sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines)
    at = len(FORM)
    out[:, at : 2 * at] = np.sqrt(np.maximum(out[:, :at], 0))
    at *= 2
    for column, size in ((len(PER_WORD), SHAPES), (len(PER_WORD) + 1, WORDS)):
        hits = np.bincount(doc * size + of[:, column].astype(np.int64), minlength=docs * size).reshape(docs, size)
        out[:, at : at + size] = np.sqrt(hits / n[:, None])
        at += size
    return out


# ------------------------------------------------------------------------------------------ the model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, ridge: float = 0.0) -> tuple[float, np.ndarray, float]:
    """(non-negative risk, the gradient to follow, the estimated risk on negatives) of weights; the first column of p and u is 1."""
    zp, zu = p @ w, u @ w
    soft = lambda z: np.logaddexp(0, z)
    positive, negative = prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean()
    g_positive = -prior * (p.T @ _sigmoid(-zp)) / len(p)
    g_negative = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    held = ridge * np.concatenate([[0.0], w[1:]])
    if negative < 0:
        return positive + ridge * (w[1:] ** 2).sum() / 2, held - g_negative, negative
    return positive + negative + ridge * (w[1:] ** 2).sum() / 2, g_positive + g_negative + held, negative


def _descend(gradient, size: int, steps: int = 400, rate: float = 0.03) -> np.ndarray:
    """Adam; the mean of the last quarter of its steps."""
    w, m, v, mean = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
    last = steps // 4
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps - last:
            mean += w / last
    return mean


def _some(x: np.ndarray, batch: int, rng: np.random.Generator) -> np.ndarray:
    return x if len(x) <= batch else x[rng.integers(0, len(x), batch)]


def class_prior(p: np.ndarray, u: np.ndarray, batch: int = 1000, ridge: float = 1e-3, doubt: float = 0.1, seed: int = 7) -> float:
    """The share of positives in u, from p and u: fitted on one half of each, read off the scores of the other."""
    half = lambda x: (x[::2], x[1::2])
    (p0, p1), (u0, u1) = half(p), half(u)
    if min(map(len, (p1, u1))) < 10:
        return 0.5

    rng = np.random.default_rng(seed)

    def gradient(w: np.ndarray) -> np.ndarray:
        a, b = _some(p0, batch, rng), _some(u0, batch, rng)
        return -a.T @ _sigmoid(-(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + ridge * w

    w = _descend(gradient, p.shape[1])
    sp, su = np.sort(-(p1 @ w)), np.sort(-(u1 @ w))
    in_p = np.arange(1, len(sp) + 1) / len(sp)
    in_u = np.searchsorted(su, sp, side="right") / len(su)
    slack = np.sqrt(np.log(4 / doubt) / (2 * len(sp))) + np.sqrt(np.log(4 / doubt) / (2 * len(su)))
    best = int(np.argmin((in_u + (1 + 0.01) * slack) / in_p))
    return float(np.clip(in_u[best] / in_p[best], 0.01, 0.99))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_scaled(x, self.mean, self.scale) @ self.weights)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled, far values drawn in, with a leading 1."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.ones((len(x), 1)), z], axis=1)


def train(p: np.ndarray, u: np.ndarray, batch: int = 1000, ridge: float = 2e-3, seed: int = 11) -> Model:
    """Fit on figures of positives and of unlabelled texts; without either, every score is the prior of one half."""
    if not len(p) or not len(u):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE + 1), 0.5)
    mean, scale = u.mean(axis=0, dtype=np.float64), np.maximum(u.std(axis=0, dtype=np.float64), 1e-3)
    p, u = _scaled(p, mean, scale), _scaled(u, mean, scale)
    prior, rng = class_prior(p, u), np.random.default_rng(seed)

    def gradient(w: np.ndarray) -> np.ndarray:
        return risk(w, _some(p, batch, rng), _some(u, batch, rng), prior, ridge)[1]

    return Model(mean, scale, _descend(gradient, SIZE + 1), prior)


# ------------------------------------------------------------------------------------------ Spark


def fold_of(doc_id: Column) -> Column:
    """The fold of a document; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _sampled(docs: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """The figures of all these documents, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                if len(lexicon) > 200_000:
                    lexicon = Lexicon()
                x = figures(part.column(1).to_pylist(), lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "x"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t")).mapInArrow(run, "i bigint, x binary").collect()
    x = [np.frombuffer(r["x"], dtype=np.float32) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["i"]).encode()), r["i"], r["x"]))]
    return np.stack(x) if x else np.zeros((0, SIZE), dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on documents outside the held-out fold: those labelled 1 against all, whatever their label.

    An id with labels that disagree is no trusted positive; null labels and ids count for nothing. Samples are about
    `positives` and `unlabelled` rows by a hash of the id (repeated rows of an id stay together).
    """
    marked = labels.select(F.col(doc_id).alias("i"), F.col(quality).alias("q")).where("i IS NOT NULL AND q IS NOT NULL").where(fold_of(F.col("i")) != 0)
    trusted = marked.groupBy("i").agg(F.min("q").alias("q")).where("q = 1").select("i")
    share = lambda tag, i: F.pmod(F.xxhash64(F.lit(tag), i), F.lit(1_000_000))
    rows, known = docs.where(F.col(doc_id).isNotNull() & (fold_of(F.col(doc_id)) != 0)).count(), trusted.count()
    some = trusted.where(share("trusted", F.col("i")) < 1_000_000 * min(1.0, positives / max(known, 1))).limit(2 * positives)
    usable = docs.where(F.col(doc_id).isNotNull() & (fold_of(F.col(doc_id)) != 0))
    p = _sampled(by_ids(usable, doc_id, F.broadcast(some), "left_semi").limit(4 * positives), doc_id, text)  # 2 * positives ids at most
    u = _sampled(usable.where(share("unlabelled", F.col(doc_id)) < 1_000_000 * min(1.0, unlabelled / max(rows, 1))).limit(2 * unlabelled), doc_id, text)
    return train(p, u)


FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
_LEXICONS: dict[str, tuple[Model, Lexicon]] = {}
CACHES.append(_LEXICONS)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the score of each text and whether it reaches the threshold; also the names of the two columns.

    Rows are scored one by one, without a shuffle: repeated rows get equal scores, a null text that of the empty text,
    and an empty table gives none.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # SIZE numbers

    def kernel(texts: list) -> list:
        if not texts:
            return [[], []]
        if key not in _LEXICONS or len(_LEXICONS[key][1]) > 200_000:
            _LEXICONS.clear()
            _LEXICONS[key] = shared.value, Lexicon()
        model, lexicon = _LEXICONS[key]
        s = model.scores(figures(texts, lexicon))
        return [s, (s >= threshold).astype(np.int32)]

    out, names = append_columns(docs, text, FIELDS, kernel, rows=64)
    return out, {f: n for (f, _), n in zip(FIELDS, names)}
