"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

Lines are parsed into quote levels (`>`, nested and spaced as mail programs write them). Quoted blocks
of one level are unwrapped and cut into sentences; each is normalised and hashed. A quoted sentence is
linked to the earliest message of the conversation that holds it outside any quote. The parent of a message
is the one that most of its outermost quotes come from. Threads and depths follow from the parents by
pointer doubling.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import append_columns, cut, stored

_PREFIX = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_HEAD = re.compile(r"^[ \t]*(?:On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*\ba écrit|El\b.*\bescribió)[ \t]*:[ \t]*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NOT_WORD = re.compile(r"[\W_]+")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, quoted block)]): attribution lines before a quote go, quote marks go, own line breaks stay."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _PREFIX.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and _HEAD.match(own[-1]):
                    own.pop()
            if level != last:
                blocks.append((level, []))
            blocks[-1][1].append(line[m.end() :])
        last = level
    while own and not own[-1].strip():
        own.pop()
    while own and not own[0].strip():
        own.pop(0)
    return "\n".join(own), [(k, "\n".join(b)) for k, b in blocks]


def sentences(text: str) -> list[str]:
    """Normalised sentences: lower case, words only, single spaces; those without a word are dropped."""
    out = (_NOT_WORD.sub(" ", s.lower()).strip() for s in _SENTENCE.split(" ".join(text.split())))
    return [s for s in out if s]


FIELDS = [
    ("body", T.StringType()),
    ("units", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("weight", T.LongType()), T.StructField("hash", T.BinaryType())]))),
]


def _parsed(texts: list) -> list:
    """Of each text its own part, and a (level, length, hash) of every sentence, level 0 for its own."""
    import xxhash

    bodies, units = [], []
    for text in texts:
        own, blocks = parse(text)
        bodies.append(own)
        units.append([{"level": level, "weight": len(s), "hash": xxhash.xxh3_128_digest(s)} for level, block in [(0, own), *blocks] for s in sentences(block)])
    return [bodies, units]


def link(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """A row per message: conv_id, turn, role, body, parent_turn, thread_turn, depth, quoted, linked.

    `messages` has conv_id, turn, role, text. `quoted` counts its quoted sentences, `linked` those found in an earlier
    message of the conversation. Votes for the parent weigh a sentence's length; the outermost level that is linked at all
    votes; ties go to the later message. A message without a linked quote opens a thread. A null text is empty. Rows with a
    null conv_id or turn are returned without links. Rows that repeat a conv_id and turn are one message
    in the links and keep a row each. Read a conversation by (thread_turn, depth, turn): a parent comes before its replies.
    An empty table gives none.
    """
    base = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    base = stored(append_columns(base, "text", FIELDS, _parsed)[0].drop("text"), "messages")  # each text is parsed once
    units = base.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", F.inline("units"))
    origin = units.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quotes = units.where("level > 0").groupBy("conv", "turn", "level", "hash").agg(F.max("weight").alias("weight"), F.count("*").alias("times"))
    found = quotes.join(origin, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    found = cut(found.select("conv", "turn", "level", "weight", "times", "origin"))
    counts = found.groupBy("conv", "turn").agg(F.sum("times").alias("quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("times")).otherwise(0)).alias("linked"))
    votes = found.where("origin IS NOT NULL").groupBy("conv", "turn", "level", "origin").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("votes"), F.col("origin"))).alias("b"))
    parents = cut(best.select("conv", "turn", F.col("b.origin").alias("parent")))
    # Pointer doubling: after k rounds `top` is 2^k replies up, or the message that opens the thread.
    # Only messages whose top is not yet known to open its thread are joined again.
    jump = parents.select("conv", "turn", F.col("parent").alias("top"), F.lit(1).cast("bigint").alias("depth"), F.lit(True).alias("open"))
    for _ in range(rounds):
        up = jump.select("conv", F.col("turn").alias("top"), F.col("top").alias("over"), F.col("depth").alias("more"))
        step = jump.where("open").join(up, ["conv", "top"], "left")
        step = step.select("conv", "turn", F.coalesce("over", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("over").isNotNull().alias("open"))
        jump = cut(jump.where("NOT open").unionByName(step))
        if jump.where("open").isEmpty():
            break
    jump = jump.drop("open")
    info = parents.join(jump, ["conv", "turn"])
    facts = counts.join(info, ["conv", "turn"], "left").select(
        F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "parent", "top", "depth", "quoted", "linked"
    )
    out = base.drop("units").join(facts, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.col("parent").alias("parent_turn"),
        F.coalesce("top", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
        F.coalesce("quoted", F.lit(0).cast("bigint")).alias("quoted"),
        F.coalesce("linked", F.lit(0).cast("bigint")).alias("linked"),
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as a mail thread writes them: a turn quotes the one before, and that one's quote of the one before it.

    Of rows that repeat a turn the least text is quoted. Rows without conv_id or turn quote nothing and are not quoted.
    """
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def said(k: int):
        marks = F.concat(F.lit("> " * k), F.regexp_replace("text", "\n", "\n" + "> " * k)) if k else F.col("text")
        return F.struct((F.col("turn") + k).alias("turn"), F.lit(k).alias("kind"), (F.col("role") if not k else F.lit(None).cast("string")).alias("role"), marks.alias("text"))

    # Each text travels once as itself and once as each of its quotes, all in one shuffle.
    rows = c.select("conv_id", F.inline(F.array(*map(said, range(3))))).where("kind = 0 OR (conv_id IS NOT NULL AND turn IS NOT NULL)")
    here = Window.partitionBy("conv_id", "turn")
    quote = lambda k: F.min(F.when(F.col("kind") == k, F.col("text"))).over(here)
    both = rows.select("*", quote(1).alias("q1"), quote(2).alias("q2")).where("kind = 0")
    head = F.when(F.col("q1").isNotNull(), F.lit("On Monday someone wrote:"))
    return both.select("conv_id", "turn", "role", F.concat_ws("\n", head, "q2", "q1", "text").alias("text"))
