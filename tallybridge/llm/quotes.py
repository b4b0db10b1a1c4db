"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` marks it begins with, blanks between them
allowed. Neighbouring lines of one level form a passage, and so do, inside it, its
paragraphs and its lines; normalised (case, marks and white space folded away, unless
nothing else is there) and hashed, they are what a quote and an original can share.

A quoted passage points at the earliest message that wrote it itself: one of its own
conversation before it, or else the earliest of all other conversations if it has
``LEAST_CHARS`` characters. The largest unit that finds an
original counts. A message answers the latest message of its conversation that it quotes
at the lowest level; without such a quote it answers the latest turn before it, however
many turns are missing between them. So the first turn is the one root of a conversation.

A message's position is its place in the walk from the root that goes through every answer
with all below it, answers to one message by turn. The walk enters and leaves every
message; positions and depths are running sums along it, found by pointer doubling, so a
thread of n messages takes about log2(2n) rounds and no task holds a conversation.
``assembled`` puts the messages' own texts together in that order.

Cases: NULL and empty texts have no passages and empty bodies; messages with a NULL
conversation or turn are kept, linked with nothing, at depth and position 0; rows that
repeat ``(conv_id, turn)`` are one node, and each row resolves its own quotes; an
attribution line (it ends in a colon and stands right before a quote) goes with the quote;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallybridge.llm import arrays
from tallybridge.workspace import Workspace

# Shortest text, normalised, that another conversation's message is the original of.
LEAST_CHARS = 12
# Positions of a conversation that an assembled row holds.
PART = 1000

_MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_FOLD = re.compile(r"[\W_]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_ATTRIBUTION = re.compile(r"\S.*:\s*$")

PARSED = (
    "row long, conv_id long, turn long, role string, body string, "
    "own array<struct<hash:long,far:boolean>>, quoted array<struct<level:int,rank:int,passage:int,hash:long,far:boolean>>, "
    "n_quotes long"
)


def levels(text: str) -> list[tuple[int, str]]:
    """Maximal runs of lines of one quote level, without their marks."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group(1).count(">") if marks else 0
        content = line[marks.end() :] if marks else line
        if runs and runs[-1][0] == level:
            runs[-1][1].append(content)
        else:
            runs.append((level, [content]))
    return [(level, "\n".join(lines)) for level, lines in runs]


def body_of(runs: list[tuple[int, str]]) -> str:
    """What a message says itself, without quotes and the lines that introduce them."""
    out = []
    for k, (level, text) in enumerate(runs):
        if level:
            continue
        if k + 1 < len(runs):
            lines = text.rstrip().split("\n")
            if _ATTRIBUTION.match(lines[-1]):
                text = "\n".join(lines[:-1])
        out.append(text.strip("\n"))
    return "\n".join(t for t in out if t.strip())


def fingerprint(text: str) -> tuple[int, bool] | None:
    """Hash of a text that is not blank, and whether it is long enough for other conversations."""
    folded = " ".join((_FOLD.sub(" ", text.lower()) if text.strip() else "").split()) or "".join(text.split())
    if not folded:
        return None
    return xxhash.xxh3_64_intdigest(folded) - (1 << 63), len(folded) >= LEAST_CHARS


def units(text: str) -> list[tuple[int, int, bool]]:
    """Rank (0 whole, 1 paragraph, 2 line), hash and reach of every unit of a passage."""
    out: dict[tuple[int, bool], int] = {}
    for rank, parts in enumerate(([text], _PARAGRAPH.split(text), text.split("\n"))):
        for part in parts:
            h = fingerprint(part)
            if h is not None:
                out.setdefault(h, rank)
    return [(rank, *h) for h, rank in out.items()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, own, quoted, n_quotes = [], [], [], []
        for text in batch.column(4).to_pylist():
            runs = levels(text or "")
            body = body_of(runs)
            bodies.append(body)
            own.append([{"hash": h, "far": far} for _, h, far in units(body)])
            n_quotes.append(sum(1 for level, passage in runs if level and passage.strip()))
            quoted.append(
                [
                    {"level": level, "rank": rank, "passage": k, "hash": h, "far": far}
                    for k, (level, passage) in enumerate(runs)
                    if level
                    for rank, h, far in units(passage)
                ]
            )
        quote = pa.struct([("level", pa.int32()), ("rank", pa.int32()), ("passage", pa.int32()), ("hash", pa.int64()), ("far", pa.bool_())])
        unit = pa.struct([("hash", pa.int64()), ("far", pa.bool_())])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:4], pa.array(bodies, pa.string()), pa.array(own, pa.list_(unit)), pa.array(quoted, pa.list_(quote)),
                pa.array(n_quotes, pa.int64()),
            ],
            ["row", "conv_id", "turn", "role", "body", "own", "quoted", "n_quotes"],
        )


def _preceding(nodes: DataFrame, group: list[str], name: str, workspace: Workspace) -> DataFrame:
    """``nodes`` with the latest earlier turn of their group as ``name``.

    Groups are cut where ranges of rows end, so that one of any size is shared by many tasks.
    """
    ranges = nodes.repartitionByRange(*group, "turn").withColumn("range", F.spark_partition_id())
    ranges = workspace.store(ranges, "ranges")
    inside = Window.partitionBy(*group, "range").orderBy("turn")
    # A row per group and range it reaches into.
    ends = ranges.groupBy(*group, "range").agg(F.max("turn").alias("end"))
    carried = ends.withColumn("carried", F.lag("end").over(Window.partitionBy(*group).orderBy("range"))).drop("end")
    return (
        ranges.withColumn(name, F.lag("turn").over(inside))
        .join(carried, [*group, "range"], "left")
        .withColumn(name, F.coalesce(name, "carried"))
        .drop("range", "carried")
    )


def _places(nodes: DataFrame, workspace: Workspace) -> DataFrame:
    """``conv_id, turn, depth, position`` from every node's parent turn.

    The walk has two stops a node, entering (``leaves`` false) and leaving it. Each stop
    points at the one before it; a round doubles how far back it points, adding up the
    entries (+1) and the levels (+1 entering, -1 leaving) on the way.
    """
    answers = nodes.where("parent IS NOT NULL")
    elder = _preceding(answers, ["conv_id", "parent"], "elder", workspace).unionByName(
        nodes.where("parent IS NULL").withColumn("elder", F.lit(None).cast("long"))
    )
    youngest = answers.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.max("turn").alias("youngest"))
    walk = elder.join(youngest, ["conv_id", "turn"], "left")
    entering = walk.select(
        "conv_id", "turn", F.lit(False).alias("leaves"),
        F.coalesce("elder", "parent").alias("back"), F.col("elder").isNotNull().alias("back_leaves"),
        F.lit(1).cast("long").alias("entries"), F.lit(1).cast("long").alias("level"),
    )
    leaving = walk.select(
        "conv_id", "turn", F.lit(True).alias("leaves"),
        F.coalesce("youngest", "turn").alias("back"), F.col("youngest").isNotNull().alias("back_leaves"),
        F.lit(0).cast("long").alias("entries"), F.lit(-1).cast("long").alias("level"),
    )
    state = workspace.store(entering.unionByName(leaving), "walk")
    while not state.where("back IS NOT NULL").isEmpty():
        before = state.select(
            "conv_id", F.col("turn").alias("back"), F.col("leaves").alias("back_leaves"), F.col("back").alias("next"),
            F.col("back_leaves").alias("next_leaves"), F.col("entries").alias("more"), F.col("level").alias("higher"),
        )
        moved = state.where("back IS NOT NULL").join(before, ["conv_id", "back", "back_leaves"]).select(
            "conv_id", "turn", "leaves", F.col("next").alias("back"), F.col("next_leaves").alias("back_leaves"),
            (F.col("entries") + F.col("more")).alias("entries"), (F.col("level") + F.col("higher")).alias("level"),
        )
        state = workspace.store(moved.unionByName(state.where("back IS NULL")), "walk")
    return state.where("NOT leaves").select(
        "conv_id", "turn", (F.col("level") - 1).alias("depth"), (F.col("entries") - 1).alias("position")
    )


def link_quotes(messages: DataFrame) -> DataFrame:
    """A row per message: what it answers, what it quotes, its place, and its own text."""
    spark = messages.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    source = messages.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.col("role").cast("string"), "text",
    )
    parsed = workspace.store(source.mapInArrow(_parse, PARSED), "parsed")
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    written = placed.select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "turn", "o.*")
    # One row per passage, however many messages share it.
    inside = written.groupBy("conv_id", "hash").agg(F.min("turn").alias("inside"))
    openings = written.where("far").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    anywhere = openings.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    # The earliest of any other conversation, for quotes in the first's own one.
    others = openings.join(anywhere, "hash").where("conv_id <> first.conv_id")
    others = others.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    anywhere = anywhere.join(others, "hash", "left")
    asked = placed.select("row", "conv_id", "turn", F.explode("quoted").alias("q")).select("row", "conv_id", "turn", "q.*")
    answered = (
        asked.join(inside, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
        .select(
            "row", "conv_id", "turn", "level", "rank", "passage",
            F.when(F.col("inside") < F.col("turn"), F.col("inside")).alias("near"),
            F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first")).alias("first"),
        )
    )
    # Per passage the largest unit with an original, in the conversation if there is one.
    best = answered.groupBy("row", "conv_id", "turn", "level", "passage").agg(
        F.min(F.when(F.col("near").isNotNull(), F.struct("rank", "near"))).alias("n"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("rank", "first"))).alias("f"),
    )
    quotes = best.groupBy("row").agg(
        F.min(F.when(F.col("n").isNotNull(), F.struct("level", (-F.col("n.near")).alias("back")))).alias("reply"),
        F.count_if(F.col("n").isNotNull() | F.col("f").isNotNull()).alias("n_linked"),
        F.min(F.when(F.col("n").isNull() & F.col("f").isNotNull(), F.col("f.first"))).alias("outside"),
    )
    known = placed.select("conv_id", "turn").distinct()
    previous = _preceding(known, ["conv_id"], "before", workspace)
    found = parsed.join(quotes, "row", "left").select(
        "row", "conv_id", "turn", "role", "body", (-F.col("reply.back")).alias("quoted"), F.col("reply").isNotNull().alias("by_quote"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("outside.conv_id").alias("outside_conv"), F.col("outside.turn").alias("outside_turn"),
    )
    found = workspace.store(found, "found")
    in_place = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    resolved = found.where(in_place).join(previous, ["conv_id", "turn"]).withColumn("answers", F.coalesce("quoted", "before"))
    resolved = workspace.store(resolved.drop("quoted", "before"), "resolved")
    nodes = resolved.groupBy("conv_id", "turn").agg(F.min("answers").alias("parent"))
    places = _places(workspace.store(nodes, "nodes"), workspace)
    names = [
        "conv_id", "turn", "role", "answers", "by_quote", "n_quotes", "n_linked",
        "outside_conv", "outside_turn", "depth", "position", "body",
    ]
    # Rows without a place stay out of the joins by it.
    placeless = found.where(~in_place).withColumns(
        {"answers": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "position": F.lit(0).cast("long")}
    )
    return resolved.join(places, ["conv_id", "turn"]).select(*names).unionByName(placeless.select(*names))


def assembled(linked: DataFrame, size: int = PART) -> DataFrame:
    """``conv_id, part, messages``: conversations in reply order, in the messages' own words.

    ``linked`` is what ``link_quotes`` returns. Part k holds positions from ``k * size`` on,
    so that parts of a conversation, by number, are the whole of it and none grows with it.
    Equal rows of a node are one message with their number as ``copies``; others of a node
    follow each other by role and body. Messages without a place are left out.
    """
    part = F.floor(F.col("position") / size)
    placed = linked.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    messages = placed.groupBy("conv_id", "position", "turn", "depth", "role", "body").agg(F.count("*").alias("copies"))
    return (
        messages.groupBy("conv_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "role", "body", "turn", "depth", "copies"))).alias("messages"))
    )
