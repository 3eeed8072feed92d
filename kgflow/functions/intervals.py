"""Linear-reference positions such as ``DK13+250.00~DK13+274.00`` as intervals, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = r"([A-Za-z]*K)?(\d+)\+(\d+(?:\.\d+)?)"
_EXACT = rf"(?U)^{_POINT}(?:\s*~\s*{_POINT})?$"
_ANYWHERE = rf"(?Us)^.*?{_POINT}(?:[^~]*~[^~]*?{_POINT})?[^~]*$"
_FOUND = "\x01"


def _interval(text: Column, pattern: str) -> Column:
    """One regular expression takes the text apart; lambdas bind what it gives, so that it runs once."""

    def build(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        metres = lambda i: at(i).try_cast("double") * 1000 + at(i + 1).try_cast("double")
        point = at(5) == ""
        end = F.when(point, metres(2)).otherwise(metres(5))
        ok = (at(0) == _FOUND) & metres(2).isNotNull() & end.isNotNull() & (point | (at(1) == at(4)))
        return F.when(ok, F.struct(metres(2).alias("start"), end.alias("end"), at(1).alias("prefix")))

    parts = F.split(F.regexp_replace(text, pattern, f"{_FOUND},$1,$2,$3,$4,$5,$6"), ",")
    return F.get(F.transform(F.array(parts), build), F.lit(0))


def parse_interval(text: Column) -> Column:
    """struct(start, end, prefix) in metres; a point has start = end; NULL if malformed or of two prefixes.

    ``~``, full-width tilde and em dash separate the ends; a hyphen does not.  Ends are not swapped.
    """
    return _interval(F.regexp_replace(F.trim(text), "[～—]", "~"), _EXACT)


def parse_interval_query(text: Column) -> Column:
    """The lenient form for questions: also ``起:A止:B``, and positions anywhere in their part."""
    worded = F.regexp_replace(F.trim(text), r"起\s*[:：]\s*(.*?)\s*止\s*[:：]\s*", "$1~")
    return _interval(F.regexp_replace(worded, "[～—至]", "~"), _ANYWHERE)


def overlaps(a: Column, b: Column) -> Column:
    """Closed intervals of one prefix that share a point."""
    return (a["prefix"] == b["prefix"]) & (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def contains_point(a: Column, point: Column, prefix: Column | None = None) -> Column:
    """Whether the point lies in the interval; without a prefix any will do."""
    inside = (a["start"] <= point) & (point <= a["end"])
    return inside if prefix is None else inside & (a["prefix"] == prefix)


def contains_range(a: Column, b: Column) -> Column:
    return (a["prefix"] == b["prefix"]) & (a["start"] <= b["start"]) & (b["end"] <= a["end"])
