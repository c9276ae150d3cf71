"""Text functions as column expressions: lexicons, tiers, numbers, fingerprints, SimHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers of a report, the first that matches wins; 'excluded' has no label.
TIERS = [
    ("acute", r"sore (?:left |right )?(?:knee|ankle|hamstring)|hip flexor"),
    ("soft", r"quad|calf|groin"),
    ("personal", r"coin flip|roster stash"),
    ("excluded", r"our model gives"),
    ("body", r"wrist|elbow|shoulder|ribs|toe|lower back"),
]


def tier(text: Column) -> Column:
    x = F.lower(text)
    out = None
    for name, pattern in TIERS:
        value = F.lit(None).cast("string") if name == "excluded" else F.lit(name)
        out = F.when(x.rlike(pattern), value) if out is None else out.when(x.rlike(pattern), value)
    return out.otherwise("unmatched")


def numbers(text: Column) -> Column:
    """Numbers of a text, with a following percent sign divided out: array of doubles."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?(?: percent)?)"), F.lit(1))
    plain = lambda s: F.regexp_extract(s, r"^(\d+(?:\.\d+)?)", 1).cast("double")
    return F.transform(found, lambda s: F.when(s.endswith("percent"), plain(s) / 100).otherwise(plain(s)))


def cited(number: Column, context: Column) -> Column:
    """Whether a number is in the context up to .01 or 2 %, also a hundredfold or a hundredth."""
    near = lambda x: F.exists(context, lambda c: (F.abs(x - c) <= 0.01) | (F.abs(x - c) <= 0.02 * F.abs(c)))
    return near(number) | near(number / 100) | near(number * 100)


#: Whitespace of every script, as ``str.split`` of Python has it.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def plain(text: Column, space: str = SPACE) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(text, space, " ")))


def fingerprint(text: Column, space: str = r"\s+") -> Column:
    """SHA-256 of the lower-case text with single blanks."""
    return F.sha2(plain(text, space), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` words; the whole text if it has fewer."""
    run = lambda i: F.array_join(F.slice(tokens, i, n), " ")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), run)
    return F.array_distinct(many)


def hashed_shingles(tokens: Column, n: int) -> Column:
    """64-bit hashes of ``shingles``; none without words."""
    run = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))
    # The outer array keeps the words from being split anew for every shingle.
    one = F.transform(F.array(F.transform(tokens, lambda t: F.xxhash64(t))), lambda w: F.when(F.size(w) > 0, run(w)).otherwise(F.array().cast("array<bigint>")))
    return F.get(one, F.lit(0))


def simhash(df: DataFrame, by: list[str], hash: str) -> DataFrame:
    """(by…, h): 64-bit SimHash of the hashes of each group: a bit is set where at least half of them have it.

    Plain partial sums of bits, so a group of any size is combined map-side.
    """
    one = F.lit(1).cast("long")
    bit = lambda b: F.call_function("shiftrightunsigned", F.col(hash), F.lit(b)).bitwiseAND(one)
    votes = df.groupBy(*by).agg(F.count(hash).alias("_n"), *[F.sum(bit(b)).alias(f"_b{b}") for b in range(64)])
    h = F.lit(0).cast("long")
    for b in range(64):
        h = h.bitwiseOR(F.when(2 * F.col(f"_b{b}") >= F.col("_n"), F.call_function("shiftleft", one, F.lit(b))).otherwise(F.lit(0).cast("long")))
    return votes.select(*by, h.alias("h"))
