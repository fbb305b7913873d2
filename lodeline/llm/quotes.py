"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

``parse`` splits each message into its own text and the passages it quotes, by
nesting level (a level is one leading ``>``). Passages are sentences,
lines and paragraphs, normalised (lower case, single blanks, no outer punctuation) and
hashed. ``link`` joins what is quoted to the messages whose own text has it: the earliest such message of the same conversation, or else the
earliest of all, that comes before the quoting one. A message replies to the
message that most of its passages at the first level come from (ties: the later one);
where none of these is found, the next level counts, and so on. ``thread`` follows replies
to their roots by pointer doubling. Sorting by root_conv, root_turn, depth,
conv_id, turn gives the replies in order.

How it scales. Originals are reduced to one row per passage (and per
conversation and passage) with partial aggregation, and written before the join,
so a passage that everyone quotes can be split on the quoting side. Pointer
doubling runs over messages whose root isn't known yet, in as many rounds as the logarithm of
the longest chain. No window, no per-conversation task.

Edge cases: a null or empty text has no passages and stays as it is, a text of
quotes alone becomes empty; passages under ``MIN_WORDS`` words link nothing; a
message never replies to itself, to a later one or to one without conversation
or turn; rows that share (conv_id, turn) are one message with several texts and
get one parent; null keys link nothing; very long texts are parsed whole, and repeated
passages of a message count once; other columns are kept, those named like
an output column replaced.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, new_dir, sliced, table

MIN_WORDS = 3
_LEVEL = re.compile(r"[ \t]*(?:>[ \t]?)+")
_ENDS = re.compile(r"(?<=[.!?])\s+")
_EDGE = re.compile(r"^\W+|\W+$")
INNER = ("__has", "__cites", "__levels")
OUTPUTS = ("own_text", "n_quotes", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth")


def levels(text: str) -> list[tuple[int, str]]:
    """(nesting level, line without its marks) of every line."""
    out = []
    for line in text.split("\n"):
        mark = _LEVEL.match(line)
        out.append((line[: mark.end()].count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def passages(lines: list[str]) -> list[str]:
    """Normalised paragraphs, sentences and lines of at least MIN_WORDS words."""
    found: dict[str, None] = {}
    for paragraph in "\n".join(lines).split("\n\n"):
        for part in (paragraph, *_ENDS.split(paragraph), *paragraph.split("\n")):
            words = _EDGE.sub("", part.lower()).split()
            if len(words) >= MIN_WORDS:
                found[" ".join(words)] = None
    return list(found)


def _hash(passage: str) -> int:
    value = xxhash.xxh64_intdigest(passage.encode())
    return value - (1 << 64) if value >= 1 << 63 else value


def read_message(text: str | None) -> tuple[str | None, list[int], list[int], int]:
    """Own text, hashes of its passages, hashes of the passages quoted at level one, number of quoted blocks."""
    text, has, cites, count = read_levels(text)
    return text, has, [passage for level, passage in cites if level == 1], count


def read_levels(text: str | None) -> tuple[str | None, list[int], list[tuple[int, int]], int]:
    """As ``read_message``, with (level, hash) of the passages quoted at every level."""
    if not text:
        return text, [], [], 0
    lines = levels(text)
    own = [line for level, line in lines if level == 0]
    blocks = [(level, [line for _, line in run]) for level, run in groupby(lines, key=lambda x: x[0]) if level]
    count = sum(level > 0 and (i == 0 or lines[i - 1][0] != level) for i, (level, _) in enumerate(lines))
    quoted = dict.fromkeys((level, _hash(p)) for level, block in blocks for p in passages(block))
    text = "\n".join(own).strip("\n") if count else text
    return text, [_hash(p) for p in passages(own)], list(quoted), count


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with own_text, n_quotes, __has (passages of the own text), __cites (passages quoted) and __levels (of these)."""
    kept = messages.drop(*OUTPUTS, *INNER)
    place = messages.columns.index(text_col)
    fields = [T.StructField("own_text", T.StringType()), T.StructField("n_quotes", T.LongType()), T.StructField("__has", T.ArrayType(T.LongType())), T.StructField("__cites", T.ArrayType(T.LongType())), T.StructField("__levels", T.ArrayType(T.LongType()))]
    places = [messages.columns.index(c) for c in kept.columns]
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        for batch in sliced(batches):
            rows = [read_levels(t) for t in batch.column(place).to_pylist()]
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in ([r[1] for r in rows], [[p for _, p in r[2]] for r in rows], [[n for n, _ in r[2]] for r in rows]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *made], names=schema.names)

    return messages.mapInArrow(run, schema)


def _at() -> Column:
    return F.struct(F.col("conv").alias("conv"), F.col("turn_no").alias("turn_no"))


def link(parsed: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, turn_no, parent_conv, parent_turn of every message that replies to another."""
    spark = parsed.sparkSession
    keyed = parsed.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn_no"), *INNER).where("conv is not null and turn_no is not null")
    cited = keyed.select("conv", "turn_no", F.explode(F.arrays_zip("__cites", "__levels")).alias("c")).select("conv", "turn_no", F.col("c.__cites").alias("passage"), F.col("c.__levels").alias("level"))
    wanted = keyed.select("conv", "turn_no", F.explode("__has").alias("passage"))
    paths = [new_dir(spark, "quotes") for _ in range(4)]
    cited = table(cited, "", paths[0])
    # Only passages that someone quotes can match.
    wanted = table(wanted.join(cited.select("passage").distinct(), "passage", "left_semi"), "", paths[1])
    near = table(wanted.groupBy("passage", "conv").agg(F.min("turn_no").alias("near_turn")), "", paths[2])
    first = table(wanted.groupBy("passage").agg(F.min(_at()).alias("first")), "", paths[3])
    found = cited.join(near, ["passage", "conv"], "left").join(first, "passage", "left")
    target = F.when(F.col("near_turn") < F.col("turn_no"), F.struct(F.col("conv").alias("conv"), F.col("near_turn").alias("turn_no"))).when(F.col("first") < _at(), F.col("first"))
    votes = found.withColumn("to", target).where("to is not null").groupBy("conv", "turn_no", "level", "to").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "turn_no").agg(F.max_by("to", F.struct(-F.col("level"), "n", "to")).alias("to"))
    result = table(best.select("conv", "turn_no", F.col("to.conv").alias("parent_conv"), F.col("to.turn_no").alias("parent_turn")), "replies")
    drop(spark, *paths)
    return result


def thread(replies: DataFrame) -> DataFrame:
    """``replies`` with root_conv, root_turn and depth, by pointer doubling.

    A row leaves the rounds as soon as its root replies to nothing, so a few long
    threads cost further rounds of a few rows only.
    """
    columns = ("conv", "turn_no", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "final")
    known = replies.select(F.col("conv").alias("root_conv"), F.col("turn_no").alias("root_turn"), F.lit(True).alias("linked"))
    first = replies.select("*", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")).join(known, ["root_conv", "root_turn"], "left")
    now = table(first.withColumn("final", F.col("linked").isNull()).select(*columns), "threads")
    done = []
    while True:
        done.append(now.where("final"))
        left = now.where("not final")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("final")
        every = reduce(DataFrame.unionByName, [*done, left])
        up = every.select(F.col("conv").alias("root_conv"), F.col("turn_no").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("up_depth"), F.col("final").alias("up_final"))
        moved = left.drop("final").join(up, ["root_conv", "root_turn"])
        now = table(moved.select("conv", "turn_no", "parent_conv", "parent_turn", F.col("up_conv").alias("root_conv"), F.col("up_turn").alias("root_turn"), (F.col("depth") + F.col("up_depth")).alias("depth"), F.col("up_final").alias("final")), "threads")


def replies(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` as a mailing list would hold them: each quotes the turn before it, and that one's quote of the turn before.

    Turns are found by joins with one row per (conversation, turn), so a long conversation is no hot key.
    """
    said = messages.groupBy(F.col(conv_col).cast("long").alias("__conv"), F.col(turn_col).cast("long").alias("__turn")).agg(F.min(text_col).alias("__text"))
    before = lambda n: said.select(F.col("__conv").alias(f"__conv{n}"), (F.col("__turn") + n).alias(f"__turn{n}"), F.col("__text").alias(f"__said{n}"))
    found = messages
    for n in (1, 2):
        found = found.join(before(n), (F.col(conv_col).cast("long") == F.col(f"__conv{n}")) & (F.col(turn_col).cast("long") == F.col(f"__turn{n}")), "left")
    quoted = lambda n, mark: F.regexp_replace(f"__said{n}", "(?m)^", mark)
    text = F.concat_ws("\n", quoted(2, "> > "), quoted(1, "> "), F.when(F.col("__said1").isNotNull(), F.lit("")), text_col)
    return found.select(*(F.when(F.col(text_col).isNotNull(), text).alias(c) if c == text_col else F.col(c) for c in messages.columns))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Every message with its own text, its parent, its root and its depth (roots: themselves, depth 0)."""
    parsed = table(parse(messages, text_col), "messages")
    placed = thread(link(parsed, conv_col, turn_col))
    left = parsed.drop(*INNER)
    joined = left.join(placed, (left[conv_col].cast("long") == placed["conv"]) & (left[turn_col].cast("long") == placed["turn_no"]), "left")
    kept = [c for c in left.columns if c not in ("own_text", "n_quotes")]
    return joined.select(
        *(left[c] for c in kept),
        "own_text",
        "n_quotes",
        "parent_conv",
        "parent_turn",
        F.coalesce("root_conv", left[conv_col].cast("long")).alias("root_conv"),
        F.coalesce("root_turn", left[turn_col].cast("long")).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
