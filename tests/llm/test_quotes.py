import random

import pytest

from newsloom.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, body string, top int"


def brute(rows):
    """{(conv, turn): (parent, thread, depth, quoted, linked)}"""
    own, quoted = {}, {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        mine, blocks = Q.parse(text)
        for s in Q.sentences(mine):
            own[conv, s] = min(turn, own.get((conv, s), turn))
        quoted.setdefault((conv, turn), []).extend((k, s) for k, b in blocks for s in Q.sentences(b))
    parent, counts = {}, {}
    for (conv, turn), units in quoted.items():
        hit = [(k, s, own[conv, s]) for k, s in units if own.get((conv, s), turn) < turn]
        counts[conv, turn] = (len(units), len(hit))
        votes = {}
        for k, s, o in set(hit):
            votes[-k, o] = votes.get((-k, o), 0) + len(s)
        if votes:
            parent[conv, turn] = max((k, v, o) for (k, o), v in votes.items())[2]
    out = {}
    for key in quoted:
        top, depth = key[1], 0
        while (key[0], top) in parent:
            top, depth = parent[key[0], top], depth + 1
        out[key] = (parent.get(key), top, depth, *counts[key])
    return out


def rows():
    rnd = random.Random(8)
    out = [(1, 0, "user", None), (1, 1, "user", ""), (None, 0, "user", "> x y."), (2, None, "user", "a b."), (3, 0, "user", "> nobody said this."), (3, 1, "user", "Same line. Same line.")]
    for conv in range(10, 30):
        said = []
        for turn in range(rnd.randint(1, 14)):
            text = " ".join("".join(rnd.choice("abcd") for _ in range(3)) + rnd.choice(["", "", ".", "?\n"]) for _ in range(rnd.randint(1, 25)))
            quote = []
            for old in rnd.sample(said, min(len(said), rnd.randint(0, 3))):
                mark = rnd.choice(["> ", ">", ">> ", "> > ", " >"])
                quote += [mark + line for line in old.split("\n")]
            said.append(text)
            out.append((conv, turn, "user", "\n".join([*(["On Tue, A wrote:"] if quote else []), *quote, text])))
    chain = ["First words here."]
    for k in range(1, 70):
        chain.append(f"Reply number {k} stands alone.")
    out += [(99, k, "user", t if not k else f"> {chain[k - 1]}\n{t}") for k, t in enumerate(chain)]
    out += [(98, k, "user", "Same common words. " if k % 2 else "> Same common words.\nSame common words.") for k in range(40)]
    return out


def test_links_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in data], SCHEMA)
    got = Q.link(df).collect()
    assert len(got) == len(data)
    want = brute(data)
    for r in got:
        if r.conv_id is not None and r.turn is not None:
            assert (r.parent_turn, r.thread_turn, r.depth, r.quoted, r.linked) == want[r.conv_id, r.turn], r
    assert want[99, 69][2] == 69


@pytest.mark.parametrize(
    "text,body,blocks",
    [
        ("> a\n> > b\n>> c\nmine", "mine", [(1, "a"), (2, "b\nc")]),
        ("On x, y wrote:\n> q\n\nreply\n", "reply", [(1, "q")]),
        ("a > b", "a > b", []),
        (None, "", []),
        (">", "", [(1, "")]),
    ],
)
def test_parse(text, body, blocks):
    assert Q.parse(text) == (body, blocks)


def test_mail_round_trip(spark):
    data = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello there.\nHow are you?"), (1, 2, "assistant", "Well, thank you."), (1, 3, "user", "Good."), (2, 0, "user", None)]
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.body, r.parent_turn, r.depth) for r in Q.link(Q.as_mail(c)).collect()}
    assert got == {(1, 0): ("Be kind.", None, 0), (1, 1): ("Hello there.\nHow are you?", 0, 1), (1, 2): ("Well, thank you.", 1, 2), (1, 3): ("Good.", 2, 3), (2, 0): ("", None, 0)}


def test_repeats_and_empty(spark):
    c = spark.createDataFrame([(1, 0, "user", "One two three.")] * 3 + [(1, 1, "user", "> One two three.\nyes")] * 2, "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, r.parent_turn) for r in Q.link(c).collect() if r.turn) == [(1, 0), (1, 0)]
    assert Q.link(c.limit(0)).collect() == []


def plain_parse(text):
    """Another reading of quote levels: a line's level is the number of marks that lead it; blank ends of the own part go."""
    levels = []
    for line in (text or "").split("\n"):
        rest, level = line.lstrip(" \t"), 0
        while rest.startswith(">"):
            level += 1
            rest = rest[1:]
            if rest[:1] in (" ", "\t"):
                rest = rest[1:]
        levels.append((level, rest if level else line))
    own, blocks, last = [], [], 0
    for level, line in levels:
        if level == 0:
            own.append(line)
        else:
            if last == 0:
                while own and own[-1].strip() == "":
                    del own[-1]
                head = own[-1].strip(" \t") if own else ""
                if head.endswith(":") and head[:-1].rstrip(" \t").endswith("wrote") and head.startswith("On "):
                    del own[-1]
            if level == last:
                blocks[-1][1].append(line)
            else:
                blocks.append((level, [line]))
        last = level
    while own and own[-1].strip() == "":
        del own[-1]
    while own and own[0].strip() == "":
        del own[0]
    return "\n".join(own), [(k, "\n".join(b)) for k, b in blocks]


def plain_sentences(text):
    out, now = [], ""
    for w in text.split():
        now += " " + w
        if w[-1] in ".!?":
            out.append(now)
            now = ""
    out.append(now)
    clean = [" ".join("".join(c.lower() if c.isalnum() else " " for c in s).split()) for s in out]
    return [s for s in clean if s]


def test_parsing_equals_another_reading():
    rnd = random.Random(12)
    parts = ["> ", ">", ">> ", "> > ", " > ", "", "", "a b.", "On Tue, A wrote:", "c! d_e f?", "\t", "x", "End. of"]
    for _ in range(3000):
        text = "\n".join("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 7)))
        assert Q.parse(text) == plain_parse(text), repr(text)
        body = text.replace("\n", " ")
        assert Q.sentences(body) == plain_sentences(body), repr(body)


def test_long_message_and_as_mail_of_repeats(spark):
    long = "word here. " * 60_000
    c = spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "> word here.\nyes"), (1, 1, "user", "> word here.\nyes"), (None, 0, "user", "x"), (2, None, "user", "y")], "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.turn, r.parent_turn, r.quoted) for r in Q.link(c).collect()), key=str)
    assert got == sorted([(1, 0, None, 0), (1, 1, 0, 2), (1, 1, 0, 2), (None, 0, None, 0), (2, None, None, 0)], key=str)
    mail = Q.as_mail(c).collect()
    assert len(mail) == 5 and {r.text for r in mail if r.conv_id is None or r.turn is None} == {"x", "y"}
