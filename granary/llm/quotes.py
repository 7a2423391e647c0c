"""Chat formatting by quotation linking: quoted passages are hashed and met with the earlier messages of their conversation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Consecutive turns of a conversation that are ordered together; a longer conversation is ordered block by block.
BLOCK = 4096
#: Line breaks may be "\\n" or "\\r\\n"; a quoted line begins with one ">" for each level, white space between. Patterns
#: that repeat a group recurse once for each round in the JVM, so runs are matched as one possessive class and cut at signs.
MARKS = r"^[\s>]*+"
WHITE = " \t\n\x0b\f\r"
#: A line that announces a quotation below it.
ANNOUNCED = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def parsed(text: Column) -> Column:
    """The lines of a text: quote level (0: own) and what it says without the marks."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")

    def line(x: Column) -> Column:
        run = F.regexp_extract(x, MARKS, 0)
        level = F.length(run) - F.length(F.replace(run, F.lit(">"), F.lit("")))
        white = F.length(F.substring_index(run, ">", -1))  # behind the last mark; one character of it belongs to the marks
        said = F.when(level > 0, F.substr(x, F.length(run) - F.greatest(white - 1, F.lit(0)) + 1)).otherwise(x)
        return F.struct(level.alias("level"), said.alias("said"))

    return F.transform(lines, line)


def tidy(text: Column) -> Column:
    """The text without leading blank lines and white space at its end."""
    lead = F.regexp_extract(text, r"^[ \t\n]*+", 0)
    blank = F.length(lead) - F.length(F.substring_index(lead, "\n", -1))
    return F.rtrim(F.substr(text, blank + 1), F.lit(WHITE))


def own_lines(lines: Column) -> Column:
    """The unquoted lines, but those that announce a quotation right below."""
    announced = lambda x, i: x["said"].rlike(ANNOUNCED) & (F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)) > 0)
    return F.transform(F.filter(lines, lambda x, i: (x["level"] == 0) & ~announced(x, i)), lambda x: x["said"])


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def keys(lines: Column) -> Column:
    """What a passage can be known by: the whole, each paragraph and each line; normalised, distinct, none empty."""
    whole = F.array_join(lines, "\n")
    every = F.concat(F.array(whole), F.split(whole, r"\n\s*\n"), lines)
    return F.array_distinct(F.filter(F.transform(every, _plain), lambda x: x != ""))


def messages(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """conv, turn, and the parsed lines of every message that has both."""
    return df.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), parsed(F.col(text)).alias("lines"))


def parents(said: DataFrame) -> DataFrame:
    """conv, turn, parent: the earlier message that a message quotes most, at its least nested level that links at all.

    Every earlier message that shares a key counts, by the total length of the keys it shares; ties go to the later
    one. Only hashes of keys are shuffled, by conversation, and a task holds one conversation at a time; no pair of
    messages is ever a row.
    """
    levels = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda v: v > 0)))
    # Lines of another level break a passage; a blank line in their place keeps its paragraphs apart.
    before = F.concat(F.array(F.lit(-1)), F.transform("lines", lambda x: x["level"]))
    broken = F.zip_with("lines", before, lambda x, b: F.struct(x["level"].alias("level"), F.when(x["level"] == b, x["said"]).otherwise(F.concat(F.lit("\n"), x["said"])).alias("said")))
    passage = lambda v: F.transform(F.filter("broken", lambda x: x["level"] == v), lambda x: x["said"])
    quoted = F.flatten(F.transform(levels, lambda v: F.transform(keys(passage(v)), lambda k: F.struct(v.alias("level"), F.xxhash64(k).alias("h"), F.length(k).alias("size")))))
    own = F.transform(keys(own_lines(F.col("lines"))), lambda k: F.xxhash64(k))
    rows = said.withColumn("broken", broken).select("conv", "turn", own.alias("own"), quoted.alias("quoted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in common.groups(batches, "conv"):
            found = most_quoted(t.column("turn").to_pylist(), t.column("own").to_pylist(), t.column("quoted").to_pylist())
            if found:
                turn, parent = zip(*found)
                conv = t.column("conv").combine_chunks().take(pa.array([0] * len(found)))
                yield pa.RecordBatch.from_arrays([conv, pa.array(turn, pa.int64()), pa.array(parent, pa.int64())], names=["conv", "turn", "parent"])

    n = max(common.partitions(said.sparkSession), 1)
    out = T.StructType([said.schema["conv"], T.StructField("turn", T.LongType()), T.StructField("parent", T.LongType())])
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "turn").mapInArrow(work, out)


def most_quoted(turn: list[int], own: list[list[int]], quoted: list[list[dict[str, int]]]) -> list[tuple[int, int]]:
    """(turn, parent) of each turn of a conversation that quotes an earlier one. The rows are in order of turn.

    Messages with the same quoted keys among their own count once, as the latest of them. A passage's keys are tried from
    the rarest on: what has none of those tried reaches at most the total of the rest, so the search ends, with the
    same result as if every pair were counted, where that can't win any more.
    """
    wanted = {k["h"] for row in quoted for k in row}
    said: dict[int, dict[frozenset[int], int]] = {}  # by key: the sets that have it, each with its latest turn, in order of turn
    out = []
    for t, rows in groupby(range(len(turn)), key=turn.__getitem__):
        same = list(rows)
        levels: dict[int, dict[int, int]] = {}
        for k in (k for i in same for k in quoted[i]):
            if k["h"] in said:
                levels.setdefault(k["level"], {})[k["h"]] = k["size"]
        if levels:
            out.append((t, _best(levels[min(levels)], said)))
        mine = frozenset(h for i in same for h in own[i] if h in wanted)
        for h in mine:
            sets = said.setdefault(h, {})
            sets.pop(mine, None)
            sets[mine] = t
    return out


def _best(sizes: dict[int, int], said: dict[int, dict[frozenset[int], int]]) -> int:
    """The turn that shares the most of these keys by size, the latest of equals."""
    rest = sum(sizes.values())
    best = (0, 0)
    tried: set[frozenset[int]] = set()
    for h in sorted(sizes, key=lambda h: (len(said[h]), -sizes[h], h)):
        if best[0] > rest:
            break
        for mine, t in reversed(said[h].items()):
            if mine in tried:
                continue
            tried.add(mine)
            score = sum(n for k, n in sizes.items() if k in mine)
            best = max(best, (score, t))
            if score >= rest:  # none untried has more, and none of as much is later
                return best[1]
        rest -= sizes[h]
    return best[1]


def turns(said: DataFrame) -> DataFrame:
    """The distinct turns of each conversation, each with the one before it."""
    from pyspark.sql import Window as W

    block = F.floor(F.col("turn") / BLOCK)
    distinct = said.select("conv", "turn").distinct().withColumn("block", block)
    inside = distinct.withColumn("before", F.lag("turn").over(W.partitionBy("conv", "block").orderBy("turn")))
    last = distinct.groupBy("conv", "block").agg(F.max("turn").alias("last")).withColumn("carried", F.lag("last").over(W.partitionBy("conv").orderBy("block")))
    return inside.join(last.select("conv", "block", "carried"), ["conv", "block"]).select("conv", "turn", F.coalesce("before", "carried").alias("before"))


def roots(links: DataFrame) -> DataFrame:
    """conv, turn, root and depth of every turn, from its parent (null at a root), by doubling the step until none is left.

    A round joins only the turns that haven't reached their root; those that have are set aside.
    """
    found = links.select("conv", "turn", F.coalesce("parent", "turn").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"))
    moving = common.stored(found.where("depth > 0"))
    known = found.where("depth = 0")
    while not moving.isEmpty():
        above = known.unionByName(moving).select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = moving.join(above, (moving.conv == above.c) & (moving.up == above.t)).select("conv", "turn", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        after = common.stored(joined)
        known = known.unionByName(after.where("more = 0").drop("more"))
        moving = after.where("more > 0").drop("more")
    return known.select("conv", "turn", F.col("up").alias("root"), "depth")


def ranked(tree: DataFrame) -> DataFrame:
    """tree with position: the place of each turn in its conversation by root, then turn; a reply follows what it answers."""
    from pyspark.sql import Window as W

    blocked = tree.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = blocked.groupBy("conv", "root", "block").agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.sum("n").over(W.partitionBy("conv").orderBy("root", "block")) - F.col("n"))
    inside = blocked.withColumn("k", F.row_number().over(W.partitionBy("conv", "root", "block").orderBy("turn")))
    return inside.join(ahead.select("conv", "root", "block", "ahead"), ["conv", "root", "block"]).select("conv", "turn", "root", "depth", (F.col("ahead") + F.col("k")).cast("long").alias("position"))


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", linear: bool = True) -> DataFrame:
    """df with each message's text without quotes, and n_quoted, quote_depth, parent_turn, linked, root_turn, depth, position.

    parent_turn is the earlier message whose own text a message quotes (linked); without such a quotation it is the
    message before (linear) or none. root_turn and depth place it in its reply tree. position orders a conversation by
    root and turn, from 1, so a reply comes after what it answers. Rows that share a conversation and turn share these.
    A null or empty text is an empty message; a row without conversation or turn stands alone, at position 1. Quoted
    lines of no known origin are removed too. Names that df has already get an underscore more.
    """
    common.ship(df.sparkSession)
    said = messages(df, conv, turn, text)
    linked = turns(said).join(parents(said), ["conv", "turn"], "left")
    chosen = linked.select("conv", "turn", F.coalesce("parent", F.col("before") if linear else F.lit(None).cast("long")).alias("parent"), F.col("parent").isNotNull().alias("linked"))
    links = common.stored(chosen)
    name = lambda n: common.free_name(df, n)
    c, t, p = name("_conv"), name("_turn"), name("_placed")
    placed = links.join(ranked(roots(links)), ["conv", "turn"]).select(F.col("conv").alias(c), F.col("turn").alias(t), F.struct("parent", "linked", "root", "depth", "position").alias(p))
    # The lines are a column of their own, so that they are parsed once and not for each line.
    held = name("_lines")
    given, lines = df.withColumn(held, parsed(F.col(f"`{text}`"))), F.col(held)
    levels = F.transform(lines, lambda x: x["level"])
    plain = tidy(F.array_join(own_lines(lines), "\n"))
    rows = given.select(
        *[plain.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns],
        F.size(F.filter(levels, lambda v: v > 0)).cast("long").alias(name("n_quoted")),
        F.array_max(levels).cast("long").alias(name("quote_depth")),
    )
    met = rows.join(placed, (F.col(f"`{conv}`") == F.col(c)) & (F.col(f"`{turn}`").cast("long") == F.col(t)), "left")
    alone = F.col(c).isNull()
    return met.select(
        *[F.col(f"`{x}`") for x in rows.columns],
        F.col(f"{p}.parent").alias(name("parent_turn")),
        F.coalesce(f"{p}.linked", F.lit(False)).alias(name("linked")),
        F.when(alone, F.col(f"`{turn}`").cast("long")).otherwise(F.col(f"{p}.root")).alias(name("root_turn")),
        F.coalesce(f"{p}.depth", F.lit(0)).cast("long").alias(name("depth")),
        F.coalesce(f"{p}.position", F.lit(1)).cast("long").alias(name("position")),
    )
