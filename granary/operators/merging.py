"""Deduplication of records and field-wise merging of one record's versions from ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking


def title_key(c: Column) -> Column:
    """What titles are compared by: lower case, without white space, underscores, middle dots and hyphens."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_·\-]+", ""))


def compact_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def richest(df: DataFrame, keys: list[str], richness: str, pos: str) -> DataFrame:
    """Of each key the row of the largest richness, the first on a tie."""
    return ranking.keep_best(df, keys, -F.col(richness), F.col(pos))


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return ranking.keep_best(df, keys, F.col(pos))


def last_wins(df: DataFrame, keys: list[str], *pos: str) -> DataFrame:
    return ranking.keep_last(df, keys, *[F.col(p) for p in pos])


def first_filled(value: str, rank: str) -> Column:
    """An aggregate: the first value in rank order that is neither null nor empty."""
    filled = F.col(value).isNotNull() & (F.col(value).cast("string") != "")
    return F.min_by(F.when(filled, F.col(value)), F.when(filled, F.col(rank)))


def longest(value: str, rank: str) -> Column:
    """An aggregate: the longest list, that of the first rank on a tie."""
    return F.max_by(F.col(value), F.struct(F.size(value), -F.col(rank)))


def union_in_order(value: str, rank: str) -> Column:
    """An aggregate over lists: all their elements in rank order, each once. A record has a list for each source at most."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))), lambda s: s["v"])
    return F.array_distinct(F.flatten(ordered))


def folded_maps(maps: Column, value_type: str = "string") -> Column:
    """A fold over maps in order: of what is there and the next map, the one with more keys wins on shared keys, what is there on a tie."""
    empty = F.expr(f"cast(map() as map<string,{value_type}>)")
    without = lambda m, other: F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))
    return F.aggregate(maps, empty, lambda acc, m: F.when(F.size(m) > F.size(acc), F.map_concat(m, without(acc, m))).otherwise(F.map_concat(acc, without(m, acc))))


def merge_sources(df: DataFrame, key: str, rank: str, scalars: list[str], lists: list[str], unions: list[str], maps: list[str] = ()) -> DataFrame:
    """One row for each key: scalars are the first filled, lists the longest, unions in rank order, maps folded.

    df should hold one row for each key and source, so a key's rows are as few as the sources.
    """
    folds = [folded_maps(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.map_entries(m).alias("v")))), lambda s: F.map_from_entries(s["v"])), "string").alias(m) for m in maps]
    return df.groupBy(key).agg(*[first_filled(c, rank).alias(c) for c in scalars], *[longest(c, rank).alias(c) for c in lists], *[union_in_order(c, rank).alias(c) for c in unions], *folds)


def dense_steps(texts: Column) -> Column:
    """A list of texts as numbered steps: leading numbers are stripped, blanks dropped, the rest numbered from 1."""
    clean = F.filter(F.transform(texts, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)]\s*", ""))), lambda x: x != "")
    return F.transform(clean, lambda x, i: F.struct((i + 1).alias("step"), x.alias("description")))


def circled_steps(text: Column) -> Column:
    """Steps that circled digits set off; a text without any is one step."""
    parts = F.filter(F.transform(F.split(text, "[①-⑮]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct((i + 1).alias("step"), x.alias("description")))


def listed_names(text: Column) -> Column:
    """Ingredient names of a free text: split at separators, brackets, amounts and labels stripped, 2 to 20 characters kept."""
    x = F.split(text, r"[,\n·•|]")
    x = F.transform(x, lambda s: F.regexp_replace(s, r"\([^)]*\)", ""))
    x = F.transform(x, lambda s: F.regexp_replace(s, r"\s*[0-9]+[0-9./]*\s*[A-Za-z가-힣]*\s*$", ""))
    x = F.transform(x, lambda s: F.trim(F.regexp_replace(s, r"^[가-힣]*:", "")))
    return F.filter(x, lambda s: (F.length(s) > 1) & (F.length(s) <= 20))
