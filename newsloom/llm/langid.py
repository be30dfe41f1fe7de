"""Language identification of code-switched text by a linear-chain conditional random field.

Every word gets a label. Its features are character n-grams with word edges (so affixes are among them)
in hashed buckets, and its entry in a lexicon of the training words; transitions between the labels of
neighbouring words are learned. Training sequences are spliced from spans of documents of different
languages, so switches occur in them. Labelling uses forward-backward; a document's language is the one
with the largest expected share of its words.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import CACHES, append_columns

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Bounds of the training sample: documents a language, documents in all, characters taken of a sampled document.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 250, 20_000, 30_000
#: A column with more distinct values is refused: it is hardly a language.
MAX_LANGUAGES = 512
#: Words of the lexicon a language, and weights of a model: 0.5 GB as doubles (twice while it is trained), 0.3 GB in the broadcast.
LEXICON_SIZE, MAX_WEIGHTS = 3000, 1 << 26
UND = "und"


def core(token: str) -> str:
    """A token in lower case without what is no letter at its ends; '' if it has no letter."""
    token = token.lower()
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the active features of every word, as flat arrays."""
    joined = "".join([f"\x02{w}\x03" for w in words])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, buckets = [], []
    for k in ORDERS:
        if len(chars) < k:
            continue
        n = len(chars) - k + 1
        code = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            code = (code + chars[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        inside = owner[:n] == owner[k - 1 :]
        owners.append(owner[:n][inside])
        buckets.append((code[inside] >> np.uint64(16)).astype(np.int64) % BUCKETS)
    known = [(i, BUCKETS + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        a, b = zip(*known)
        owners.append(np.array(a))
        buckets.append(np.array(b))
    if not owners:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # from x to

    def unary(self, words: list[str]) -> np.ndarray:
        owner, bucket = features(words, self.lexicon)
        n, m = len(words), len(self.labels)
        out = np.empty((n, m))
        for k in range(m):
            out[:, k] = np.bincount(owner, weights=self.weights[bucket, k], minlength=n)
        return out


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def marginals(unary: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Exact label marginals of many sequences laid end to end, by forward-backward in two levels.

    Sequences are cut into chunks. One pass multiplies the step matrices of each chunk, a short pass
    carries the forward and backward messages over the chunks of a sequence, and two last passes run
    inside the chunks. Every pass works on all chunks at once. Before its first word a sequence is in
    each label with equal weight.
    """
    total, m = unary.shape
    if not total:
        return np.empty((0, m))
    lengths = lengths[lengths > 0]
    per = -(-lengths // chunk)
    first = np.cumsum(per) - per
    kcount = int(per.sum())
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(kcount) - first[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + nth * chunk
    size = np.minimum(lengths[seq] - nth * chunk, chunk)
    steps = int(size.max())
    e = np.exp(unary - unary.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    grid = np.minimum(begin[:, None] + np.arange(steps), total - 1)
    on = np.arange(steps) < size[:, None]
    ones = e[grid]  # chunks x steps x labels
    many = kcount > len(lengths)
    if many:
        product = np.broadcast_to(np.eye(m), (kcount, m, m)).copy()
        for s in range(steps):
            nxt = _scaled((product @ a) * ones[:, s, None, :], (1, 2))
            product = np.where(on[:, s, None, None], nxt, product)
    ahead, behind = np.full((kcount, m), 1.0 / m), np.full((kcount, m), 1.0 / m)
    for j in range(1, int(per.max())):
        at = np.flatnonzero(nth == j)
        ahead[at] = _scaled(np.einsum("ki,kij->kj", ahead[at - 1], product[at - 1]), 1)
    for j in range(int(per.max()) - 2, -1, -1):
        at = np.flatnonzero((nth == j) & (nth < per[seq] - 1))
        behind[at] = _scaled(np.einsum("kij,kj->ki", product[at + 1], behind[at + 1]), 1)
    alpha = np.empty((kcount, steps, m))
    now = ahead
    for s in range(steps):
        now = np.where(on[:, s, None], _scaled((now @ a) * ones[:, s], 1), now)
        alpha[:, s] = now
    now = behind
    for s in range(steps - 1, -1, -1):
        alpha[:, s] *= now
        now = np.where(on[:, s, None], _scaled((ones[:, s] * now) @ a.T, 1), now)
    gamma = _scaled(alpha, 2)
    out = np.empty((total, m))
    out[grid[on]] = gamma[on]
    return out


def _pair_marginals(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and summed marginals of label pairs, for equally long training sequences."""
    n, steps, m = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = np.full((n, m), 1.0 / m)
    for s in range(steps):
        now = alpha[:, s] = _scaled((now @ a) * e[:, s], 1)
    now = np.full((n, m), 1.0 / m)
    for s in range(steps - 1, -1, -1):
        beta[:, s] = now
        now = _scaled((e[:, s] * now) @ a.T, 1)
    gamma = _scaled(alpha * beta, 2)
    pair = alpha[:, :-1, :, None] * a[None, None] * (e * beta)[:, 1:, None, :]
    return gamma, _scaled(pair, (2, 3)).sum(axis=(0, 1))


def train(texts: list[str], langs: list[str], epochs: int = 4, sequences: int | None = None, steps: int = 64, seed: int = 7, ridge: float = 1e-6) -> Crf:
    """Fit on labelled texts by AdaGrad on the conditional log-likelihood of spliced sequences: 1500, or ten a language if these are more.

    The lexicon has LEXICON_SIZE words a language, fewer where the model would pass MAX_WEIGHTS.
    """
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    labels = sorted(set(langs))
    by: dict[str, list[list[str]]] = {x: [] for x in labels}
    for i in order:
        words = [w for w in map(core, texts[i].split()) if w]
        if words:
            by[langs[i]].append(words)
    labels = [x for x in labels if by[x]]
    m = len(labels)
    if not m:
        return Crf([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    counts: dict[str, int] = {}
    for docs in by.values():
        for words in docs:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    top = sorted(counts, key=lambda w: (-counts[w], w))[: min(LEXICON_SIZE * m, MAX_WEIGHTS // m - BUCKETS)]
    lexicon = {w: i for i, w in enumerate(w for w in top if counts[w] > 1)}
    rng = np.random.default_rng(seed)
    sequences = sequences or max(1500, 10 * m)
    vocabulary: dict[str, int] = {}
    ids, gold = np.zeros((sequences, steps), dtype=np.int64), np.zeros((sequences, steps), dtype=np.int64)
    for i in range(sequences):
        t, label = 0, int(rng.integers(m))
        while t < steps:
            docs = by[labels[label]]
            words = docs[int(rng.integers(len(docs)))]
            n = min(steps - t, int(rng.geometric(1 / 20)) + 2, len(words))
            at = int(rng.integers(len(words) - n + 1))
            for w in words[at : at + n]:
                ids[i, t] = vocabulary.setdefault(w, len(vocabulary))
                gold[i, t] = label
                t += 1
            if m > 1 and rng.random() < 0.7:
                label = (label + int(rng.integers(1, m))) % m
    owner, bucket = features(list(vocabulary), lexicon)
    size = BUCKETS + len(lexicon)
    w, tr = np.zeros((size, m)), np.zeros((m, m))
    gw, gt = np.full((size, m), 1e-6), np.full((m, m), 1e-6)
    batch = 250
    for _ in range(epochs):
        for start in range(0, sequences, batch):
            x, y = ids[start : start + batch], gold[start : start + batch]
            unary = np.stack([np.bincount(owner, weights=w[bucket, k], minlength=len(vocabulary)) for k in range(m)], axis=1)
            u = unary[x]
            e = np.exp(u - u.max(axis=2, keepdims=True))
            gamma, pair = _pair_marginals(e, np.exp(tr - tr.max()))
            gamma[np.arange(len(x))[:, None], np.arange(steps), y] -= 1
            by_word = np.stack([np.bincount(x.ravel(), weights=gamma[:, :, k].ravel(), minlength=len(vocabulary)) for k in range(m)], axis=1)
            for k in range(m):
                g = np.bincount(bucket, weights=by_word[owner, k], minlength=size) / len(x) + ridge * w[:, k]
                gw[:, k] += g * g
                w[:, k] -= 0.3 * g / np.sqrt(gw[:, k])
            np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
            g = pair / len(x) + ridge * tr
            gt += g * g
            tr -= 0.3 * g / np.sqrt(gt)
    return Crf(labels, lexicon, w.astype(np.float32), tr)


class Labeller:
    """A model with a cache of the unary scores of the tokens that it has met."""

    def __init__(self, model: Crf, limit: int = 250_000):
        self.model, self.limit = model, limit
        self._ids: dict[str, int] = {}
        self._scores = np.zeros((1024, len(model.labels)))
        self._lettered = np.zeros(1024, dtype=bool)

    def _learn(self, tokens: list[str]) -> None:
        if len(self._ids) + len(tokens) > self.limit:
            self._ids.clear()
        at = len(self._ids)
        need = at + len(tokens)
        if need > len(self._scores):
            grow = max(need, 2 * len(self._scores))
            self._scores = np.concatenate([self._scores, np.zeros((grow - len(self._scores), self._scores.shape[1]))])
            self._lettered = np.concatenate([self._lettered, np.zeros(grow - len(self._lettered), dtype=bool)])
        cores = [core(t) for t in tokens]
        for k, t in enumerate(tokens):
            self._ids[t] = at + k
        lettered = np.array([bool(c) for c in cores])
        self._scores[at:need] = 0
        if lettered.any():
            self._scores[at:need][lettered] = self.model.unary([c for c in cores if c])
        self._lettered[at:need] = lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [t.split() if t else [] for t in texts]
        if not self.model.labels:
            return [UND] * len(texts), [0.0] * len(texts)
        if sum(map(len, split)) > self.limit:  # few long texts at once, whole ones each
            if len(texts) > 1:
                half = len(texts) // 2
                a, b = self.predict(texts[:half]), self.predict(texts[half:])
                return a[0] + b[0], a[1] + b[1]
            vocabulary: dict[str, int] = {}
            ids = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in split[0]], dtype=np.int64)
            cores = [core(t) for t in vocabulary]
            lettered = np.array([bool(c) for c in cores])
            scores = np.zeros((len(cores), len(self.model.labels)))
            for k in range(0, len(cores), 50_000):
                scores[k : k + 50_000] = self.model.unary(cores[k : k + 50_000]) * lettered[k : k + 50_000, None]
            return self._judge(scores[ids], lettered[ids], np.array([len(ids)]))
        ids = self._ids
        missing = list(dict.fromkeys(t for words in split for t in words if t not in ids))
        if missing:
            before = len(ids)
            self._learn(missing)
            if len(ids) < before + len(missing):  # the cache was emptied
                rest = list(dict.fromkeys(t for words in split for t in words if t not in ids))
                if rest:
                    self._learn(rest)
        get = ids.__getitem__
        flat = np.array([get(t) for words in split for t in words], dtype=np.int64)
        return self._judge(self._scores[flat], self._lettered[flat], np.array([len(x) for x in split]))

    def _judge(self, unary: np.ndarray, lettered: np.ndarray, lengths: np.ndarray) -> tuple[list[str], list[float]]:
        gamma = marginals(unary, lengths, self.model.transitions)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        shares = np.stack([np.bincount(doc, weights=gamma[:, k] * lettered, minlength=len(lengths)) for k in range(gamma.shape[1])], axis=1)
        words = np.bincount(doc, weights=lettered, minlength=len(lengths))
        best = shares.argmax(axis=1)
        score = np.clip(shares[np.arange(len(lengths)), best] / np.maximum(words, 1), 0, 1)
        langs = [self.model.labels[k] if w else UND for k, w in zip(best, words)]
        return langs, np.where(words > 0, score, 0.0).tolist()


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, fold: int | None = 2, folds: int = 4) -> tuple[list[str], list[str]]:
    """A bounded sample of the labelled documents outside the held-out fold.

    At most about SAMPLE_DOCS documents a language and SAMPLE_TOTAL in all, by a hash of the id. Of a longer text, SAMPLE_CHARS
    characters are taken, from a place that a hash of the id tells. These bounds hold for the training sample alone.
    """
    usable = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    if fold is not None:
        usable = usable.where(F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(folds)) != fold)
    counts = usable.groupBy("l").count()
    labels = counts.limit(MAX_LANGUAGES + 1).count()
    if labels > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is that column a language?")
    if not labels:
        return [], []
    each = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // labels))
    share = F.pmod(F.xxhash64(F.lit("sample"), "i"), F.lit(1_000_000))
    parts = counts.select(F.col("l").alias("_l"), F.least(F.lit(1.0), each / F.col("count")).alias("_share"))  # a row per language
    rows = usable.join(F.broadcast(parts), F.col("l") == F.col("_l")).where(share < F.col("_share") * 1_000_000)
    begin = 1 + F.pmod(F.xxhash64(F.lit("span"), "i"), F.greatest(F.lit(1), F.length("t") - (SAMPLE_CHARS - 1)))
    rows = rows.select(F.substring("t", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), "l").limit(2 * each * labels).collect()
    return [r[0] for r in rows], [r[1] for r in rows]


FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
_LABELLERS: dict[str, Labeller] = {}
CACHES.append(_LABELLERS)


def identify(docs: DataFrame, model: Crf, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the predicted language and its share of the words; also the names of the two columns.

    A null text or one without a letter is `und` with score 0. Rows are judged one by one: repeated rows
    get equal answers, and an empty table gives none. Ties go to the first language by name.
    """
    sc = docs.sparkSession.sparkContext
    shared, key = sc.broadcast(model), uuid.uuid4().hex  # BUCKETS + lexicon rows, whatever the corpus

    def kernel(texts: list) -> list:
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(shared.value)
        return list(_LABELLERS[key].predict(texts)) if texts else [[], []]

    out, names = append_columns(docs, text, FIELDS, kernel, rows=256)
    return out, {f: n for (f, _), n in zip(FIELDS, names)}


def held_out(doc_id: int | None, fold: int = 2, folds: int = 4) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    return train(*training_sample(docs, doc_id, text, lang))
