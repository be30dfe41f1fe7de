"""Quality rules: word statistics of whole texts, and the fertility of a public tokeniser.

A text that passes the base rules is encoded with a byte-level vocabulary; three figures are held
against the bands of its language, or of its script where the language is unknown or written in another script than
most of the text's letters:

* characters per token: junk (symbols, shouting, random strings) breaks into many short tokens;
* byte-fallback share: tokens that are not whole UTF-8 text by themselves, i.e. pieces of one character;
* token entropy in bits: worn-out and spun texts draw on few tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import append_columns, bpe, default_ranks, free_name

WORDS_MIN = 10
REPEAT_PERCENT = 20
WINDOW = 5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Fixed bands: least and most characters per token, most byte-fallback share, least token entropy in bits of a long text.
#: Those of languages were chosen on labelled documents, those of scripts on a few plain sentences each.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "en": (2.40, 8.0, 0.015, 5.8),
    "de": (2.33, 8.0, 0.04, 5.6),
    "fr": (2.15, 8.0, 0.09, 5.5),
    "es": (2.08, 8.0, 0.09, 5.5),
    "latin": (1.00, 9.0, 0.55, 4.5),
    "greek": (0.70, 3.0, 0.70, 4.0),
    "cyrillic": (0.70, 3.0, 0.70, 4.0),
    "hebrew": (0.65, 3.0, 0.85, 3.8),
    "arabic": (0.75, 3.0, 0.70, 4.0),
    "devanagari": (0.45, 2.0, 0.99, 3.5),
    "thai": (0.35, 2.0, 1.00, 3.0),
    "cjk": (0.30, 2.5, 0.99, 4.0),
    "other": (0.25, 9.0, 1.00, 3.0),
}
#: Means of few tokens scatter: bands widen by these over the square root of the token count.
SLACK_CHARS, SLACK_FALLBACK, SLACK_ENTROPY = 4.0, 1.5, 15.0
#: Fixed ranges of code points by script.
SCRIPTS = [
    (0x41, 0x5A, "latin"),
    (0x61, 0x7A, "latin"),
    (0xC0, 0x24F, "latin"),
    (0x370, 0x3FF, "greek"),
    (0x400, 0x52F, "cyrillic"),
    (0x5D0, 0x5EA, "hebrew"),
    (0x620, 0x6FF, "arabic"),
    (0x750, 0x77F, "arabic"),
    (0x900, 0x97F, "devanagari"),
    (0x980, 0xDFF, "other"),
    (0xE00, 0xE7F, "thai"),
    (0xE80, 0x10FF, "other"),
    (0x1100, 0x11FF, "cjk"),
    (0x1200, 0x1DFF, "other"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x318F, "cjk"),
    (0x3400, 0x9FFF, "cjk"),
    (0xA000, 0xABFF, "other"),
    (0xAC00, 0xD7AF, "cjk"),
    (0xFB50, 0xFDFF, "arabic"),
    (0x10000, 0x1CFFF, "other"),
    (0x20000, 0x3FFFF, "cjk"),
]
_NAMES = sorted({x[2] for x in SCRIPTS})
_FIRST, _LAST = (np.array([x[k] for x in SCRIPTS]) for k in (0, 1))
_SCRIPT = np.array([_NAMES.index(x[2]) for x in SCRIPTS])


def word_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    return n, chars, symbols, dup_lines, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    k = len(seen)
    if k > n - 2:  # hardly a word repeats, so no window does
        return 0
    two = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
    m = int(two.max()) + 1
    if m > n - WINDOW + 2:
        return 0
    four = np.unique(two[:-2] * m + two[2:], return_inverse=True)[1]
    five, count = np.unique(four[:-1] * k + ids[4:], return_inverse=True, return_counts=True)[1:]
    again = np.flatnonzero(count[five] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < WORDS_MIN or 100 * n_repeat_words > REPEAT_PERCENT * n_words


_PARTIAL: dict[str, np.ndarray] = {}


def _partial(path: str) -> np.ndarray:
    """For each token id: is it a piece of a character, not text by itself?"""
    if path not in _PARTIAL:
        tokens = bpe(path).tokens
        out = np.zeros(max(tokens) + 1, dtype=bool)
        for i, raw in tokens.items():
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                out[i] = True
        _PARTIAL[path] = out
    return _PARTIAL[path]


def fertility(text: str, path: str) -> tuple[int, float, float, float]:
    """(tokens, characters per token, byte-fallback share, token entropy in bits)."""
    ids = bpe(path).ids(text)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
    return n, len(text) / n, float(_partial(path)[ids].mean()), entropy


def script_of(text: str) -> str:
    """The script of most letters of the whole text; latin on a tie with another or without letters, else the first by name."""
    if text.isascii():
        return "latin"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    at = np.searchsorted(_FIRST, code, side="right") - 1
    letter = (at >= 0) & (code <= _LAST[at])
    counts = np.bincount(_SCRIPT[at[letter]], minlength=len(_NAMES))
    return "latin" if counts[_NAMES.index("latin")] == counts.max() else _NAMES[int(counts.argmax())]


def band_of(text: str, lang: str | None, table: dict) -> str:
    """The language's band, if it has one and most letters are Latin as its own; else the script's."""
    script = script_of(text)
    if script == "latin" and lang in table:
        return lang
    return script if script in table else "other"


def in_band(band: tuple[float, float, float, float], n: int, per: float, fallback: float, entropy: float) -> bool:
    low, high, most, least = band
    root = n**0.5
    near = SLACK_CHARS / root
    return low - near <= per <= high + near and fallback <= most + SLACK_FALLBACK / root and entropy >= least - SLACK_ENTROPY / root


FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("n_tokens", T.LongType()),
    ("chars_per_token", T.DoubleType()),
    ("fallback_share", T.DoubleType()),
    ("token_entropy", T.DoubleType()),
]


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str | None = "lang", vocabulary: str | None = None, bands: dict | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns of FIELDS; also the name that each field got.

    Null and blank texts have no words and fail the base rules. A text that fails them is not
    encoded: its fertility columns are null and it is not kept. Rows are judged one by one, so
    repeated rows get equal verdicts; an empty table gives none. A null or unknown language takes
    the band of the script. `bands` may replace BANDS; languages in it are taken for ones in Latin letters.
    """
    path = vocabulary or default_ranks()
    table = bands or BANDS

    def judge(item: str | None) -> tuple:
        code, _, body = (item or "\x00").partition("\x00")
        stats = word_statistics(body)
        failed = base_fails(stats[0], stats[4])
        if failed:
            return (*stats, True, False, None, None, None, None)
        n, per, fallback, entropy = fertility(body, path)
        kept = in_band(table[band_of(body, code, table)], n, per, fallback, entropy)
        return (*stats, False, kept, n, per, fallback, entropy)

    def kernel(items: list) -> list:
        return list(zip(*map(judge, items))) if items else [[] for _ in FIELDS]

    code = F.coalesce(F.col(lang), F.lit("")) if lang else F.lit("")
    # A language code holds no NUL, so the first one ends it, whatever the text holds.
    packed = F.concat(F.translate(code, "\x00", ""), F.lit("\x00"), F.coalesce(F.col(text), F.lit("")))
    temp = free_name(docs.columns, "_packed")
    out, names = append_columns(docs.withColumn(temp, packed), temp, FIELDS, kernel)
    return out.drop(temp), {f: n for (f, _), n in zip(FIELDS, names)}
