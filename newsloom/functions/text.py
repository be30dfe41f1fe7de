"""Column expressions on titles, texts and URLs; all run inside whole-stage code."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lists of query parameters that do not change what a page holds.
TRACKING_PREFIXES = ["utm_", "pk_", "at_", "ns_", "_ga", "mtm_", "piwik_"]
TRACKING_NAMES = [
    "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "yclid", "igshid", "ref", "referer", "referrer", "source", "cmp", "ncid", "sid", "s_kwcid", "spm",
    "share", "sharedfrom", "cid", "outputtype",
]
#: Fixed list of titles and articles before a name.
NAME_PREFIXES = [
    "el", "la", "los", "las", "don", "doña", "presidente", "president", "presidenta", "ministro", "ministra", "министр", "президент", "председатель", "глава", "лидер",
    "экс", "vicepresidente", "vicepresidenta", "líder", "lider",
]
#: Accented letters to their base letters (lower case), after compatibility forms.
_PAIRS = [("áàâäãåā", "a"), ("éèêëēėę", "e"), ("íìîïī", "i"), ("óòôöõō", "o"), ("úùûüū", "u"), ("ñ", "n"), ("ç", "c"), ("ýÿ", "y"), ("й", "и"), ("ё", "е")]
ACCENTED = "".join(a for a, _ in _PAIRS)
PLAIN = "".join(b * len(a) for a, b in _PAIRS)


_TAIL = re.compile(r"\s*[|–—-]\s*[^|–—-]{2,30}$")
_PUNCTUATION = re.compile(r"[^\w\s]")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\x0B\f]+", " "))


def fold(c: Column) -> Column:
    """Lower case without diacritics; sharp s becomes two."""
    return F.replace(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def normalize_title(title: Column) -> Column:
    """A title without its outlet tail, case, diacritics and punctuation."""
    x = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"\s*[|–—-]\s*[^|–—-]{2,30}$", "")
    return squeeze(F.regexp_replace(fold(x), r"[^\p{L}\p{N}_\s]", " "))


def exact_title(title: Column) -> Column:
    """`normalize_title` with compatibility forms (NFKC), full case folding and every combining mark, for any script; Arrow batches."""

    @F.pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            x = _TAIL.sub("", unicodedata.normalize("NFKC", t or "").strip()).casefold()
            x = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
            return " ".join(_PUNCTUATION.sub(" ", x).split())

        return s.map(one)

    return exact(title)


def title_hash(title: Column, exact: bool = False) -> Column:
    """The first half of the SHA-256 of a normalised title; built-in functions know the accents of Latin and Cyrillic, `exact` all others too."""
    return F.substring(F.sha2(exact_title(title) if exact else normalize_title(title), 256), 1, 32)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www. and amp., no default port, fragment, tracking or blank parameters; sorted query; no double, closing or /amp slashes. What is not http stays."""
    u = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(u, r"^(?i)https?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", 0)
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^(?i)https?://([^/?#]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", ""), r"^amp\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?i)https?://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.regexp_replace(F.regexp_replace(path, "/amp$", ""), "(.)/+$", "$1")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    dull = "^(" + "|".join([f"{x}.*" for x in TRACKING_PREFIXES] + TRACKING_NAMES) + ")$"
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~name(p).rlike(dull)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    web = F.concat(F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1)), F.lit("://"), host, path, tail)
    return F.when(rest != "", web).otherwise(u)


def strip_html(html: Column) -> Column:
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return squeeze(x)


def count_sentences(text: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"[.!?…]+(?:\s|$)")
    return F.size(F.filter(parts, lambda s: F.trim(s) != ""))


def words(text: Column) -> Column:
    """Normalised words of a text; an empty array without any."""
    return F.filter(F.split(normalize_title(text), " "), lambda w: w != "")


def shingles(w: Column, n: int) -> Column:
    """Distinct windows of n words."""
    starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def stems(text: Column, size: int = 5, over: int = 3) -> Column:
    """Distinct first letters of the words of more than `over` characters."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) > over), lambda w: F.substring(w, 1, size)))


def stem_overlap(a: Column, b: Column) -> Column:
    """Shared stems over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def entity_key(surface: Column) -> Column:
    """A name without case, marks, punctuation but hyphens, and leading titles."""
    x = squeeze(F.regexp_replace(fold(F.coalesce(surface, F.lit(""))), r"[^\p{L}\p{N}_\s-]", " "))
    heads = "|".join(sorted({p for p in NAME_PREFIXES} | {"dona"}))
    return F.trim(F.regexp_replace(F.concat(x, F.lit(" ")), f"^(({heads}) +)+", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), "^-|-$", "")


def clip(text: Column, n: int) -> Column:
    """At most n characters, cut at a space, with an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, n), r"\s+\S*\z", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(head, F.lit("…")))


def embedding_input(title: Column, text: Column, chars: int = 1500) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, chars)))


def hashtag(category: Column) -> Column:
    """#tag of a category: other characters become _, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(category)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(x != "", F.concat(F.lit("#"), x)).otherwise("")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def quote_found(quote: Column, text: Column, least_words: int = 4) -> Column:
    """Is the normalised quote, if long enough, a substring of the normalised text?"""
    q = F.array_join(words(quote), " ")
    return (F.size(words(quote)) >= least_words) & F.contains(F.array_join(words(text), " "), q)


def round_signed(x: Column, digits: int) -> Column:
    """Rounded half away from zero; unlike `round`, what a negative number leaves is a negative zero, as in IEEE arithmetic and DuckDB."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5).cast("double") / scale)
