"""Column functions over text: rule cascades, scored choices, recoding, amounts, prices, dates and character counts."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(pattern: str) -> str:
    """The pattern with Unicode classes, as they are outside the JVM."""
    return pattern if pattern.startswith("(?U") else f"(?U){pattern}"


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in the text."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(u(pattern)), F.lit(label)).otherwise(out)
    return out


def scored_argmax(scores: list[tuple[str, Column]], least: float, default: str) -> Column:
    """The label of the largest score, the first on a tie, or the default below `least`."""
    best = F.greatest(*[s for _, s in scores])
    out = F.lit(None).cast("string")
    for label, s in reversed(scores):
        out = F.when(s == best, F.lit(label)).otherwise(out)
    return F.when(best < least, F.lit(default)).otherwise(out)


def recoded(c: Column, values: dict[str, str], default: str) -> Column:
    """A recode by table; other values pass, null and empty become the default."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, c), F.nullif(c, F.lit("")), F.lit(default))


def any_text_matches(columns: list[Column], pattern: str) -> Column:
    return F.concat_ws(" ", *columns).rlike(pattern)


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other, each on what the one before left."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern rewrites, one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, u(r[0]), r[1]), rules, c)


def longest_keyword(c: Column, keywords: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the longest keyword that the text contains, the first listed on a tie."""
    out = F.lit(default).cast("string")
    for keyword, label in reversed(sorted(keywords, key=lambda k: -len(k[0]))):
        out = F.when(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(label)).otherwise(out)
    return out


def number(c: Column) -> Column:
    """A number as text, or null; only plain decimal notation counts."""
    clean = F.trim(F.regexp_replace(c, ",", ""))
    return F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("double"))


def last_number(c: Column) -> Column:
    """The last number in the text; both comma and point set off thousands."""
    found = F.regexp_extract_all(c, F.lit(r"(\d{1,3}(?:[,.]\d{3})+|\d+)"), 1)
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), "[,.]", "").try_cast("double")


VULGAR = {"½": 0.5, "⅓": 0.333, "⅔": 0.667, "¼": 0.25, "¾": 0.75}


def amount_and_unit(c: Column) -> Column:
    """struct(amount, unit): a fraction, a decimal or a vulgar fraction, then the rest; else amount 0 and the text as unit."""
    t = F.trim(c)
    a, b = F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)", 1), F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)", 2)
    fraction = F.try_divide(a.try_cast("double"), b.try_cast("double"))
    f_rest = F.trim(F.regexp_replace(t, r"^\d+\s*/\s*\d+\s*", ""))
    dec = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1)
    d_rest = F.trim(F.regexp_replace(t, r"^\d+(?:\.\d+)?\s*", ""))
    sign = F.substring(t, 1, 1)
    v = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(VULGAR.items())]), sign)
    v_rest = F.trim(F.substr(t, F.lit(2)))
    make = lambda x, y: F.struct(x.cast("double").alias("amount"), y.alias("unit"))
    return F.when(fraction.isNotNull() & (a != ""), make(fraction, f_rest)).when(dec != "", make(dec.try_cast("double"), d_rest)).when(v.isNotNull(), make(v, v_rest)).otherwise(make(F.lit(0.0), t))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD as text where the parts are in range; two-digit years are of this century. Month lengths aren't checked."""
    y, m, d = year.try_cast("int"), month.try_cast("int"), day.try_cast("int")
    y = F.when(F.length(year) == 2, y + 2000).otherwise(y)
    good = y.between(2000, 2099) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", y, m, d))


def find_date(c: Column, patterns: list[str]) -> Column:
    """The first valid date by patterns of three groups (year, month, day), tried in order."""
    return F.coalesce(*[iso_date(*[F.regexp_extract(c, p, g) for g in (1, 2, 3)]) for p in patterns])


def all_dates(c: Column, patterns: list[str]) -> Column:
    """All valid dates in the text by patterns of three groups (year, month, day)."""
    found = []
    for p in patterns:
        y, m, d = (F.regexp_extract_all(c, F.lit(p), g) for g in (1, 2, 3))
        found.append(F.transform(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: iso_date(x["y"], x["m"], x["d"])))
    return F.filter(F.concat(*found), lambda x: x.isNotNull())
