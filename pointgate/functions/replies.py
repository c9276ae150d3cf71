"""Replies and observations of models, read with JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_thoughts(text: Column) -> Column:
    """The text without ``<think>`` sections."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def _balanced(open_: str, close: str, depth: int) -> str:
    """A pattern for a balanced block with at most ``depth`` blocks inside each other; brackets in strings don't count."""
    text = r'"(?:[^"\\]|\\.)*+"'
    plain = rf'[^{open_}{close}"]'
    block = rf"{open_}(?:{plain}|{text})*+{close}"
    for _ in range(depth - 1):
        block = rf"{open_}(?:{plain}|{text}|{block})*+{close}"
    return block


_OBJECT, _ARRAY = _balanced(r"\{", r"\}", 7), r"(?s)(\[.*\])"


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text, up to seven levels deep; null where none."""
    return F.nullif(F.regexp_extract(text, f"(?s)({_OBJECT})", 1), F.lit(""))


def action(reply: Column) -> Column:
    """struct (kind, pick, tool, target) of a reply: kind is 'pick', 'tool', 'invalid' (an object of another kind) or 'none' (no object)."""
    blob = first_object(without_thoughts(reply))
    pick, tool = F.get_json_object(blob, "$.pick"), F.get_json_object(blob, "$.tool.name")
    kind = F.when(blob.isNull(), "none").when(pick.isNotNull(), "pick").when(tool.isNotNull(), "tool").otherwise("invalid")
    return F.struct(kind.alias("kind"), pick.alias("pick"), F.when(pick.isNull(), tool).alias("tool"), F.when(pick.isNull() & tool.isNotNull(), F.get_json_object(blob, "$.tool.arguments")).alias("target"))


def answers(reply: Column, asked: Column, least: float = 0.5) -> Column:
    """struct (answers, coverage, ok): (question_id, p) of the first array of a reply.

    Questions that were not asked and repeated answers are left out (the first one counts), p is
    clipped to 0 … 1, and the reply is ok if it answers at least ``least`` of what was asked.  Where
    the array is no valid JSON, pairs of id and number are read by pattern.
    """
    body = without_thoughts(reply)
    parsed = F.from_json(F.nullif(F.regexp_extract(body, _ARRAY, 1), F.lit("")), "array<struct<question_id string, p string>>")
    pair = r'"?question_id"?\s*[:=]\s*"?([A-Za-z0-9_:.\-]+)"?\s*,\s*"?p"?\s*[:=]\s*"?([0-9.]+)'
    ids, ps = F.regexp_extract_all(body, F.lit(pair), F.lit(1)), F.regexp_extract_all(body, F.lit(pair), F.lit(2))
    loose = F.zip_with(ids, ps, lambda i, p: F.struct(i.alias("question_id"), p.alias("p")))
    usable = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<struct<question_id:string,p:string>>")), lambda a: F.array_contains(asked, a["question_id"]) & a["p"].try_cast("double").isNotNull())
    strict = usable(parsed)
    good = F.when(F.size(strict) > 0, strict).otherwise(usable(loose))
    first = F.filter(good, lambda a, i: F.array_position(F.transform(good, lambda b: b["question_id"]), a["question_id"]) == i + 1)
    kept = F.transform(first, lambda a: F.struct(a["question_id"].alias("question_id"), F.least(F.greatest(a["p"].try_cast("double"), F.lit(0.0)), F.lit(1.0)).alias("p")))
    coverage = F.try_divide(F.size(kept), F.size(asked))
    return F.struct(kept.alias("answers"), coverage.alias("coverage"), F.coalesce(coverage >= least, F.lit(False)).alias("ok"))


def observation(message: Column, marker: str, schema: str) -> Column:
    """The JSON object after a marker in a message; null where there is no marker or no object."""
    return F.from_json(first_object(F.when(F.contains(message, F.lit(marker)), F.substring_index(message, marker, -1))), schema)


def future_dates(document: Column, as_of: Column) -> Column:
    """Evidence dates of a JSON document, at any depth, that do not lie before ``as_of``: array of strings.

    Evidence dates are the values of "published_utc" and those of "snapshot" that are a date.
    """
    key = lambda name, value: F.regexp_extract_all(document, F.lit(rf'(?<!\\)"{name}"\s*:\s*"({value})"'), F.lit(1))
    found = F.concat(key("published_utc", r"[^\"\\]*"), key("snapshot", r"\d{4}-\d{2}-\d{2}"))
    return F.filter(found, lambda d: F.coalesce(F.try_to_date(F.left(d, F.lit(10)), "yyyy-MM-dd") >= as_of, F.lit(False)))


def anchor(rates: list[tuple[Column, Column]], least: int = 20) -> Column:
    """struct (rate, n): the first rate that rests on ``least`` rows, else the one on the most; null rates don't count."""
    every = F.filter(F.array(*[F.struct(F.coalesce(n, F.lit(0)).cast("long").alias("n"), (-F.lit(i)).alias("at"), r.cast("double").alias("rate")) for i, (r, n) in enumerate(rates)]), lambda x: x["rate"].isNotNull())
    best = F.coalesce(F.try_element_at(F.filter(every, lambda x: x["n"] >= least), F.lit(1)), F.array_max(every))
    return F.struct(best["rate"].alias("rate"), F.coalesce(best["n"], F.lit(0)).alias("n"))
