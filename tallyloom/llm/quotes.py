"""Chat formatting by quotation linking.

1. Each message is split by quote level: lines that start with ``>`` marks are quoted,
   the number of marks is the level; the line that introduces a quote goes with it. What
   is left is the message's own text.
2. A quoted passage is hashed after normalising (white space, case, marks): as a whole,
   by paragraph and by line. Own texts are hashed the same way. Per hash only the first
   message that has it counts, overall and per conversation, so a line that a third of
   all messages share joins to one row.
3. A message replies to the message that most of its outermost quotes were taken from;
   without a match, to the turn before it. A reply's original always precedes it in the
   order of (conv_id, turn), so replies form trees.
4. Pointer jumping finds each message's first ancestor and depth in a logarithmic number
   of joins. A sort over all messages, cut into ranges by Spark, gives positions; the
   offsets of the ranges are all that reaches the driver. Long conversations are written
   in parts of ``PART`` messages, so no row grows without bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import map_slices, text_or_empty
from tallyloom.session import cut_lineage

PART = 500
LEAST_WORDS = 3
_MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
_INTRODUCES = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
_WORD = re.compile(r"\w+")


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage), ...]); passages in order, without their marks."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        found = _MARKS.match(line)
        if not found:
            own.append(line)
            passages.append((0, []))
            continue
        level = found.group(1).count(">")
        while own and passages and passages[-1][0] == 0 and (not own[-1].strip() or _INTRODUCES.match(own[-1])):
            introduced = bool(own[-1].strip())
            own.pop()
            if introduced:
                break
        if passages and passages[-1][0] == level:
            passages[-1][1].append(line[found.end() :])
        else:
            passages.append((level, [line[found.end() :]]))
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages if level]


def _hash(text: str) -> int | None:
    words = _WORD.findall(text.lower())
    if len(words) < LEAST_WORDS:
        return None
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def passage_hashes(text: str) -> list[int]:
    """Hashes of the whole, of its paragraphs and of its lines; short ones say nothing."""
    parts = {text, *re.split(r"\n\s*\n", text), *text.split("\n")}
    return sorted({h for h in map(_hash, parts) if h is not None})


_PARSED = (
    "conv_id long, turn long, role string, own string, n_quotes int, deepest int, "
    "own_hashes array<long>, quoted_hashes array<long>"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            own, quotes = split_quotes(text)
            outer = min((level for level, _ in quotes), default=0)
            hashes = sorted({h for level, passage in quotes if level == outer for h in passage_hashes(passage)})
            rows.append((own, len(quotes), max((level for level, _ in quotes), default=0), passage_hashes(own), hashes))
        out = pd.DataFrame(rows, columns=["own", "n_quotes", "deepest", "own_hashes", "quoted_hashes"])
        for i, column in enumerate(("conv_id", "turn", "role")):
            out.insert(i, column, pdf[column].to_numpy() if column == "role" else pdf[column].astype("Int64").to_numpy())
        yield out


def _numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``place``: its rows' places in the given order over all rows, from 0."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, part = 0, TaskContext.get().partitionId()
        for pdf in batches:
            yield pdf.assign(part=part, within=range(seen, seen + len(pdf)))
            seen += len(pdf)

    placed = cut_lineage(df.orderBy(*order).mapInPandas(count, f"{schema}, part int, within long"))
    # One number per range of the sort.
    sizes = sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, offset))
        offset += n
    starts = df.sparkSession.createDataFrame(offsets, "part int, start long")
    return placed.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("within")).drop(
        "part", "within", "start"
    )


def _before(keys: DataFrame) -> DataFrame:
    """(conv_id, turn, previous): the turn before each turn of its conversation."""
    numbered = cut_lineage(_numbered(keys.select("conv_id", "turn").distinct(), "conv_id", "turn"))
    earlier = numbered.select(
        (F.col("place") + 1).alias("place"), F.col("conv_id").alias("c"), F.col("turn").alias("previous")
    )
    return numbered.join(earlier, "place").filter(F.col("c") == F.col("conv_id")).select("conv_id", "turn", "previous")


def _parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, p_conv, p_turn, linked) for messages that reply to one."""
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    own = known.select("conv_id", "turn", F.explode("own_hashes").alias("hash"))
    quoted = known.select("conv_id", "turn", F.explode("quoted_hashes").alias("hash")).distinct()
    of_conversation = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("p_turn"))
    overall = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    near = (
        quoted.join(of_conversation, ["hash", "conv_id"])
        .filter(F.col("p_turn") < F.col("turn"))
        .select("conv_id", "turn", "hash", F.col("conv_id").alias("p_conv"), "p_turn", F.lit(1).alias("same"))
    )
    far = (
        quoted.join(overall, "hash")
        .filter(F.col("first") < F.struct("conv_id", "turn"))
        .select("conv_id", "turn", "hash", F.col("first.conv_id").alias("p_conv"), F.col("first.turn").alias("p_turn"), F.lit(0).alias("same"))
    )
    votes = (
        near.unionByName(far)
        .groupBy("conv_id", "turn", "p_conv", "p_turn")
        .agg(F.count_distinct("hash").alias("votes"), F.max("same").alias("same"))
    )
    linked = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct("votes", "same", "p_conv", "p_turn")).alias("best")
    )
    linked = linked.select("conv_id", "turn", "best.p_conv", "best.p_turn", F.lit(True).alias("linked"))
    return (
        _before(known)
        .join(linked, ["conv_id", "turn"], "full_outer")
        .select(
            "conv_id",
            "turn",
            F.coalesce("p_conv", F.when(F.col("previous").isNotNull(), F.col("conv_id"))).alias("p_conv"),
            F.coalesce("p_turn", "previous").alias("p_turn"),
            F.coalesce("linked", F.lit(False)).alias("linked"),
        )
    )


def _roots(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, r_conv, r_turn, depth) for messages that reply to one, by pointer jumping.

    In each round a message's pointer goes on by as far as the message it points to has
    come. One that has reached a first message is done and takes no further part, so the
    rounds that a few long chains need are short.
    """
    now = cut_lineage(
        parents.select(
            "conv_id",
            "turn",
            F.col("p_conv").alias("r_conv"),
            F.col("p_turn").alias("r_turn"),
            F.lit(1).cast("long").alias("depth"),
            F.lit(False).alias("done"),
        )
    )
    finished = now.limit(0)
    for _ in range(most_rounds):
        up = now.unionByName(finished).select(
            F.col("conv_id").alias("r_conv"),
            F.col("turn").alias("r_turn"),
            F.col("r_conv").alias("u_conv"),
            F.col("r_turn").alias("u_turn"),
            F.col("depth").alias("more"),
            F.col("done").alias("u_done"),
        )
        moved = cut_lineage(
            now.join(up, ["r_conv", "r_turn"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("u_conv", "r_conv").alias("r_conv"),
                F.coalesce("u_turn", "r_turn").alias("r_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                # What points to a message that replies to nothing is done.
                F.coalesce("u_done", F.lit(True)).alias("done"),
            )
        )
        finished = cut_lineage(finished.unionByName(moved.filter("done")))
        now = moved.filter(~F.col("done"))
        if now.limit(1).count() == 0:
            return finished.drop("done")
    raise RuntimeError(f"reply chains did not end in {most_rounds} rounds")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text).

    conv_id, turn, role, text (own, without quotes), n_quotes, deepest (quote level),
    p_conv and p_turn (what it replies to, NULL for a first message), linked (by a quote),
    t_conv and t_turn (first message of its thread), depth, position (in the thread, by
    depth, conv_id, turn; an original always stands before its replies).

    NULL texts are empty; NULL roles stay NULL. Rows without conv_id or turn reply to
    nothing, are replied to by nothing and stand together in a thread without a name.
    Rows that repeat a (conv_id, turn) share parent and depth, ordered by role and text.
    """
    chosen = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text_or_empty().alias("text"),
    )
    parsed = cut_lineage(map_slices(chosen, _parse, _PARSED))
    parents = cut_lineage(_parents(parsed))
    roots = _roots(parents)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = (
        parsed.join(parents, ["conv_id", "turn"], "left")
        .join(roots, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("own").alias("text"),
            "n_quotes",
            "deepest",
            "p_conv",
            "p_turn",
            F.coalesce("linked", F.lit(False)).alias("linked"),
            F.when(known, F.coalesce("r_conv", "conv_id")).alias("t_conv"),
            F.when(known, F.coalesce("r_turn", "turn")).alias("t_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )
    numbered = cut_lineage(_numbered(placed, "t_conv", "t_turn", "depth", "conv_id", "turn", "role", "text"))
    first = numbered.groupBy(F.col("t_conv").alias("s_conv"), F.col("t_turn").alias("s_turn")).agg(
        F.min("place").alias("start")
    )
    same = F.col("t_conv").eqNullSafe(F.col("s_conv")) & F.col("t_turn").eqNullSafe(F.col("s_turn"))
    return numbered.join(first, same).select(*placed.columns, (F.col("place") - F.col("start")).alias("position"))


def chat_texts(messages: DataFrame, part: int = PART) -> DataFrame:
    """Reply-ordered conversations without quotes, in parts of ``part`` messages.

    conv_id and turn of the thread's first message, part, n_messages, n_linked, doc
    (``<|role|>``, the own text, ``<|end|>`` per message). A NULL role is written as
    ``user``; an empty table gives no rows.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return (
        reply_order(messages)
        .withColumn("part", F.floor(F.col("position") / part).cast("long"))
        .groupBy(F.col("t_conv").alias("conv_id"), F.col("t_turn").alias("turn"), "part")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.sum(F.col("linked").cast("long")).alias("n_linked"),
            F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"),
        )
        .select(
            "conv_id",
            "turn",
            "part",
            "n_messages",
            "n_linked",
            F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("doc"),
        )
    )
