"""Spellings of trace ids, question ids and categories brought to one form, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(c: Column) -> Column:
    """A category up to letter case, outer blanks, and blank, hyphen or underscore between words."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return F.when(x != "", x)


def trace_key(trace: Column) -> Column:
    """A trace id in one spelling: season, letter and number, then step, subtype and sample if there.

    Case, separators, the corpus prefix and zero padding do not count: ``T11 | 2023 | E0007 | p01 |
    tool_call`` and ``2023:e7:p1:tool_call`` are the same.  Null where no season and number is found.
    """
    x = F.regexp_replace(F.lower(F.trim(trace)), r"[^a-z0-9_#]+", ":")
    x = F.regexp_replace(F.regexp_replace(x, r"^:?(t\d+:)?", ""), r":?#", ":#")
    x = F.regexp_replace(F.rtrim(x, F.lit(":")), r"(?<![0-9])0+(?=[0-9])", "")
    return F.when(x.rlike(r"^[0-9]{4}:[a-z][0-9]+"), x)


def episode_key(trace: Column) -> Column:
    """Season and episode or card of a trace id, in one spelling."""
    x = F.regexp_extract(trace_key(trace), r"^([0-9]{4}:[a-z][0-9]+)", 1)
    return F.when(x != "", x)


def trace_season(trace: Column) -> Column:
    return F.left(trace_key(trace), F.lit(4)).try_cast("int")


def question_number(question: Column) -> Column:
    """The last run of digits of a question id."""
    return F.regexp_extract(question, r"([0-9]+)[^0-9]*$", 1).try_cast("long")


#: The same in SQL, with the expression in place of {0}.
CATEGORY_SQL = r"nullif(regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g'), '')"
TRACE_SQL = (
    r"(CASE WHEN regexp_matches({0}, '[0-9]{{4}}[^0-9a-z]+[a-z][0-9]+', 'i') THEN "
    r"regexp_replace(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9_#]+', ':', 'g'), "
    r"'^:?(t[0-9]+:)?', ''), ':?#', ':#'), ':'), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g') END)"
)
EPISODE_SQL = r"nullif(regexp_extract(" + TRACE_SQL + r", '^([0-9]{{4}}:[a-z][0-9]+)', 1), '')"
