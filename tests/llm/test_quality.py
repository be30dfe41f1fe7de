import random
import re
from collections import Counter

import pytest

from newsloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def texts():
    rnd = random.Random(2)
    out = [None, "", " ", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "##|\n##|\n\n \n##|", "é è\x0ba\x85b \x1c c\nq\rq"]
    for _ in range(200):
        alphabet = [f"w{i}" for i in range(rnd.choice([2, 5, 40, 400]))]
        words = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.5:
            words += words[: rnd.randint(1, len(words))]
        out.append("".join(w + rnd.choice([" ", "  ", "\n", "\t"]) for w in words))
    return out


def test_statistics_equal_brute_force():
    for t in texts():
        assert Q.word_statistics(t) == brute(t), repr(t)


def test_query_columns_and_verdicts(spark):
    junk = "Xq### zz%%% kjq&&& " * 3 + " ".join(f"{i:x}{i * 7919:x}q###" for i in range(300))
    good = "The committee said on Monday that the new plan for public housing would be discussed again before the summer and that no decision had been taken yet"
    rows = [(1, good, "en"), (2, junk, "en"), (3, None, "en"), (4, good, None), (5, "short text", "xx"), (6, good + " \x00 end", "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, kept int")
    out, names = Q.quality_rules(docs)
    assert out.columns[:4] == docs.columns and names["kept"] == "kept_"
    got = {r.doc_id: r.kept_ for r in out.collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    for r in out.where("doc_id IN (1, 6)").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


CYRILLIC = "Комитет сообщил в понедельник, что новый план будет обсуждаться летом, и решение пока никем не принято. "


def test_script_is_that_of_the_whole_text():
    head, body = "Subject: a plain header line with some words. " * 100, CYRILLIC * 400
    assert len(head) > 4000
    assert Q.script_of(head + body) == "cyrillic" and Q.script_of(body[:4100] + head * 20) == "latin"
    assert Q.band_of(head + body, "en", Q.BANDS) == "cyrillic" and Q.band_of(body[:4100] + head * 20, "xx", Q.BANDS) == "latin"
    for text, script in (("", "latin"), ("123 !!", "latin"), ("Ωδή", "greek"), ("दिल्ली", "devanagari"), ("東京とソウル 서울", "cjk"), ("ქართული", "other"), ("abc где", "latin"), ("Ünïcödé", "latin"), ("עברית", "hebrew"), ("عربية", "arabic"), ("ไทย", "thai"), ("🙂🙂", "latin")):
        assert Q.script_of(text) == script, text


def verdict(text, lang):
    """By the public tokeniser's own ids and a count of each letter's Unicode name."""
    import math
    import unicodedata

    import public_tokenizers as P
    from tokenizers import Tokenizer

    n_words, _, _, _, repeats = brute(text)
    if n_words < 10 or 100 * repeats > 20 * n_words:
        return False, None
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = tok.encode(text, add_special_tokens=False).ids
    n = len(ids)
    part = {i: "\ufffd" in tok.decode([i]) for i in set(ids)}
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    names = Counter(unicodedata.name(c, "").split()[0].lower() for c in text if c.isalpha())
    script = names.most_common(1)[0][0] if names else "latin"
    low, high, most, least = Q.BANDS[lang if lang in Q.BANDS and script == "latin" else script]
    root = math.sqrt(n)
    figures = [low - 4 / root <= len(text) / n <= high + 4 / root, sum(part[i] for i in ids) / n <= most + 1.5 / root, entropy >= least - 15 / root]
    return all(figures), figures


def cases():
    rnd = random.Random(8)
    latin = [w for w in "the committee said on monday that new plan for public housing would be discussed again before summer and no decision had been taken yet by all of those people who came from town with their friends or family while water was cold".split()]
    words = CYRILLIC.replace(",", "").replace(".", "").split()
    draw = lambda w, n: " ".join(rnd.choice(w) for _ in range(n))
    few = " ".join(rnd.choice("ab") + rnd.choice("ab") for _ in range(20)) * 1
    return {
        "good en": (draw(latin, 400), "en"),
        "symbols": (" ".join("".join(rnd.choice("xqzj$@^~0123456789") for _ in range(9)) for _ in range(200)), "en"),
        "latin junk letters": (draw(latin, 400) + " " + " ".join(rnd.choice("ĦŧŊđŁħŦŋ") + rnd.choice(latin) for _ in range(120)), "en"),
        "few words": (" ".join(rnd.choice(["the", "of"]) for _ in range(900)), "en"),
        "few tokens": (draw(latin[:9], 1200), "en"),
        "good cyrillic": (draw(words, 400), "en"),
        "good cyrillic of no language": (draw(words, 400), None),
        "cyrillic spaced": ((" " * 60).join(draw(words, 300).split()), None),
        "cyrillic rare letters": (" ".join("".join(rnd.choice("ѠѢѤѦѨѪѬѮѰѲѴѶ") for _ in range(5)) for _ in range(300)), None),
        "cyrillic few tokens": (" ".join(rnd.choice("абвг") * rnd.randint(1, 3) for _ in range(1500)), None),
        "short": (few, "en"),
    }


def test_verdicts_equal_brute_force_and_each_figure_rejects(spark):
    want = {k: verdict(*v) for k, v in cases().items()}
    docs = spark.createDataFrame([(k, *v) for k, v in cases().items()], "doc_id string, text string, lang string")
    out, _ = Q.quality_rules(docs)
    assert {r.doc_id: r.kept for r in out.collect()} == {k: v for k, (v, _) in want.items()}
    assert want["good en"][0] and want["good cyrillic"][0] and want["good cyrillic of no language"][0]
    alone = lambda name: [k for k, ok in enumerate(want[name][1]) if not ok]
    assert alone("symbols") == [0] and alone("latin junk letters") == [1] and alone("few tokens") == [2]
    assert 2 in alone("cyrillic spaced") and 1 in alone("cyrillic rare letters") and 2 in alone("cyrillic few tokens")


@pytest.mark.parametrize("band", ["en", "de", "latin", "cyrillic", "greek", "arabic", "hebrew"])
def test_each_bound_alone_rejects(band):
    low, high, most, least = Q.BANDS[band]
    good = ((low + min(high, 5)) / 2, most / 2, least + 1)
    n = 100_000
    assert Q.in_band(Q.BANDS[band], n, *good)
    for k, bad in ((0, low - 0.1), (0, high + 0.1), (1, most + 0.01), (2, least - 0.1)):
        assert not Q.in_band(Q.BANDS[band], n, *(bad if i == k else x for i, x in enumerate(good)))


def test_empty(spark):
    out, _ = Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert out.collect() == []


def test_cached_bpe_is_the_public_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from newsloom.llm.common import CachedBpe, default_ranks

    bpe = CachedBpe(default_ranks(), limit=50)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    parts = ["Hello", " ", "  ", "   ", "\n", " \n", "\n ", "\t", "it's", "1234", "Ünï", "日本", "!!", " ", "\x1c", "a", " "]
    cases = ["", " ", "a ", " a", "a  b", "a   b", "\n  b", "x\n\t b", *texts()[1:60]]
    cases += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    for t in cases:
        assert bpe.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
