"""Words put on the driver's tables, so that queries run the shipped rules: a row's number picks words from lists, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))).cast("int"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick_sql(words: list[str], number: str) -> str:
    return f"([{', '.join(map(quoted, words))}])[(({number}) % {len(words)}) + 1]"


def first_match_sql(text: str, rules: list[tuple[str, str]], default: str) -> str:
    """A CASE over patterns in order, as DuckDB's expression engine reads them."""
    cases = " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(x)}" for p, x in rules)
    return f"CASE {cases} ELSE {default} END"
