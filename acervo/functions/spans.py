"""All matches of a pattern with their places, as columns.

No built-in function gives the offsets of all matches. What lies between matches does: a match starts after all
gaps and all matches before it. Offsets are code points, half-open, and hold for patterns that never match the
empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.folds import scan


def folded(text: Column) -> Column:
    """The text with the case of every letter gone: whatever a pattern finds without regard to case is in it in lower case."""
    return F.lower(F.translate(text, "İıſ\u212a", "iisk"))


def matches(text: Column, pattern: str, group: int | None = None, test: str | None = None) -> Column:
    """Matches in order: structs of gap (characters since the match before), width, original and valor (the group where it is set, else the match).

    The arrays are zipped before anything looks at single matches: what a lambda refers to is evaluated anew for
    every element.
    """
    columns = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")]
    if group:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def one(z: Column) -> Column:
        value = F.when(z["v"] == "", z["m"]).otherwise(z["v"]) if group else z["m"]
        return F.struct(F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("width"), z["m"].alias("original"), value.alias("valor"))

    found = F.transform(F.filter(F.arrays_zip(*columns), lambda z: z["m"].isNotNull()), one)  # there is one gap more
    return F.when(text.rlike(test or pattern), found).otherwise(F.array().cast("array<struct<gap:int,width:int,original:string,valor:string>>"))


def placed(rows: Column, names: tuple[str, ...], kind: str) -> Column:
    """Rows made of matches of several patterns (ord, gap and width, pattern after pattern) with their places: structs
    of ini, fim and the named fields. One pass adds up gaps and widths and starts anew at each pattern."""

    def step(state: Column, r: Column) -> tuple[Column, Column]:
        start = F.when(state["ord"] == r["ord"], state["at"]).otherwise(0) + r["gap"]
        end = start + r["width"]
        out = F.struct(start.alias("ini"), end.alias("fim"), *[r[n].alias(n) for n in names])
        return F.struct(r["ord"].alias("ord"), end.alias("at")), F.array(out)

    return scan(rows, F.struct(F.lit(-1).alias("ord"), F.lit(0).alias("at")), step, kind)


def find_all(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches of one pattern in order: structs of ini, fim, original and valor."""
    names = ("gap", "width", "original", "valor")
    rows = F.transform(matches(text, pattern, group), lambda m: F.struct(F.lit(0).alias("ord"), *[m[n].alias(n) for n in names]))
    return placed(rows, names[2:], "array<struct<ini:int,fim:int,original:string,valor:string>>")
