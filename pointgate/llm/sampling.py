"""Samples that match target category proportions, by systematic unequal-probability sampling.

The records of a category stand in a random order (a hash of seed and record).  A request draws
from each category with probability ``size * share / records``; laid end to end over the sorted
categories, these probabilities form one line of length ``size``, on which a random start and
every whole step after it pick a record.  A category so gets its share rounded down or up, and the
sample has the size of the request.

Floors (``min_rows``) are repaired afterwards with the next records of the category's order, and
other categories pay for them: first those whose share was rounded up, then all in proportion to
what they hold above their own floor.  The size so stays, unless the floors alone exceed it.

Nothing of this needs a category in one place.  The rank of a record is its rank within its slice
of the hash range plus the counts of the slices before it (a prefix sum over slices; their number
grows with the records, ``slice_rows`` each on average).  The ranks that a request picks follow
from its counts alone, so they are computed first, one row for each pick, and joined to the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PPM = 1_000_000


def order_key(seed: str, record: Column) -> Column:
    """The random order: hexadecimal digits, uniform and independent of partitioning."""
    return F.md5(F.concat(F.lit(seed + ":"), record).cast("binary"))


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _over(a: Column, b: Column) -> Column:
    """Whole part of a / b for numbers that are not negative."""
    return _big(F.call_function("div", _big(a), _big(b)))


def needed(size: Column, share_ppm: Column, min_rows: Column) -> Column:
    share = F.coalesce(size, F.lit(0)).cast("long") * F.coalesce(share_ppm, F.lit(0)).cast("long")
    up = F.expr("0L") + F.call_function("div", share + F.lit(PPM - 1), F.lit(PPM))
    return F.greatest(up, F.coalesce(min_rows, F.lit(0)).cast("long"))


def ranked_records(records: DataFrame, *, record: str, category: list[str], seed: str, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """((key, record, rank) of every record, (key, available) of every category)."""
    r = records.select(F.col(record).alias("_r"), _key(category).alias("_k")).withColumn("_u", order_key(seed, F.col("_r").cast("string")))
    slices = max(1, -(-records.count() // slice_rows))
    r = r.withColumn("_slice", F.floor(F.conv(F.substring("_u", 1, 12), 16, 10).cast("long") * slices / 2**48).cast("long"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = r.groupBy("_k", "_slice").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy("_k", "_slice").orderBy("_u", "_r")
    ranked = r.withColumn("_i", F.row_number().over(within)).join(counts, ["_k", "_slice"])
    return ranked.select("_k", "_r", (F.col("_i") + F.col("_before")).alias("_rank")), counts.groupBy("_k").agg(F.sum("_n").alias("available"))


def _key(category: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(category)]))


def allocation(targets: DataFrame, available: DataFrame, *, category: list[str], request: str, target: str, seed: str) -> DataFrame:
    """``targets`` with ``needed``, ``available``, ``missing``, ``drawn`` (by the line), ``added`` for the floor and ``paid`` for other floors.

    One row per target; the windows run over the targets of one request, as many as its categories.
    """
    t = targets.drop("needed", "available", "missing", "drawn", "added", "paid").withColumn("_k", _key(category))
    t = t.join(available, "_k", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    t = t.withColumn("needed", needed(F.col("sample_size"), F.col("share_ppm"), F.col("min_rows")))
    t = t.withColumn("missing", F.greatest(F.col("needed") - F.col("available"), F.lit(0)))
    share = _big(F.coalesce("sample_size", F.lit(0))) * F.coalesce("share_ppm", F.lit(0))
    # A category never has more inclusion probability than records.
    t = t.withColumn("_share", _big(share)).withColumn("_line", F.least("_share", _big(_big(F.col("available")) * PPM)))
    sorted_ = [*[F.col(c).asc_nulls_first() for c in category], F.col(target)]
    earlier = Window.partitionBy(request).orderBy(*sorted_).rowsBetween(Window.unboundedPreceding, -1)
    start = F.conv(F.substring(order_key(seed + ":start", F.col(request).cast("string")), 1, 8), 16, 10).cast("long") % PPM
    t = t.withColumn("_at", _big(F.coalesce(F.sum("_line").over(earlier), F.lit(0)) + start))
    t = t.withColumn("drawn", (_over(F.col("_at") + F.col("_line"), F.lit(PPM)) - _over(F.col("_at"), F.lit(PPM))).cast("long"))
    floor = F.least(F.coalesce("min_rows", F.lit(0)).cast("long"), F.col("available"))
    t = t.withColumn("_floor", F.greatest(floor, F.lit(0))).withColumn("added", F.greatest(F.col("_floor") - F.col("drawn"), F.lit(0)))
    whole = Window.partitionBy(request)
    t = t.withColumn("_debt", F.sum("added").over(whole))
    # First pay those who hold more than their share, those furthest above it first.
    above = F.when(F.col("drawn") > F.col("_floor"), F.col("drawn") * PPM - F.col("_share"))
    t = t.withColumn("_above", F.when(above > 0, above))
    first = F.row_number().over(Window.partitionBy(request).orderBy(F.col("_above").desc_nulls_last(), *sorted_))
    t = t.withColumn("_first", F.when(F.col("_above").isNotNull() & (first <= F.col("_debt")), 1).otherwise(0))
    # Then everyone with its share or more than its floor, in proportion; an exhausted category pays nothing.
    short = F.col("_share") > F.col("_line")
    t = t.withColumn("_spare", F.when(short, 0).otherwise(F.greatest(F.col("drawn") - F.col("_floor") - F.col("_first"), F.lit(0))))
    rest, spare = F.least(F.col("_debt") - F.sum("_first").over(whole), F.sum("_spare").over(whole)), F.sum("_spare").over(whole)
    t = t.withColumn("_rest", rest).withColumn("_spares", F.greatest(spare, F.lit(1)))
    upto = F.sum("_spare").over(Window.partitionBy(request).orderBy(*sorted_).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_upto", upto)
    part = _over(_big(F.col("_upto")) * F.col("_rest"), F.col("_spares")) - _over(_big(F.col("_upto") - F.col("_spare")) * F.col("_rest"), F.col("_spares"))
    return t.withColumn("paid", F.col("_first") + part.cast("long")).drop("_debt", "_above", "_first", "_spare", "_rest", "_spares", "_upto", "_floor", "_share")


def _runs(n: Column, chunk: int) -> Column:
    """Starts of the runs of ``chunk`` numbers that 1..n falls into, so that no long array is made."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.expr("0L") + F.call_function("div", n - 1, F.lit(chunk).cast("long"))))


def picked_ranks(plan: DataFrame, *, request: str, target: str, chunk: int = 10_000) -> DataFrame:
    """(_q, _t, _k, _rank, drawn_as) of every pick of an ``allocation``."""
    p = plan.select(F.col(request).alias("_q"), F.col(target).alias("_t"), "_k", _big(F.col("available")).alias("_n"), "_line", "_at", "drawn", "added", "paid")

    def numbered(df: DataFrame, upto: Column) -> DataFrame:
        df = df.withColumn("_upto", upto.cast("long")).withColumn("_run", F.explode(_runs(F.col("_upto"), chunk)))
        last = F.least(F.col("_upto"), (F.col("_run") + 1) * chunk)
        return df.withColumn("_m", F.explode(F.sequence(F.col("_run") * chunk + 1, last)))

    def crossed(rank: Column) -> Column:
        """Whole steps of the line up to the record of this rank."""
        return _over(F.col("_at") + _over(F.col("_line") * rank, F.col("_n")), F.lit(PPM)) - _over(F.col("_at"), F.lit(PPM))

    # The m-th crossing lies at the first rank whose part of the line reaches it.
    steps = numbered(p, F.col("drawn") - F.col("paid"))
    reach = (_over(F.col("_at"), F.lit(PPM)) + F.col("_m")) * PPM - F.col("_at")
    steps = steps.select("_q", "_t", "_k", _over(_big(reach) * F.col("_n") + F.col("_line") - 1, F.col("_line")).cast("long").alias("_rank"), F.lit("drawn").alias("drawn_as"))
    # The first ranks that no crossing hits are among the first drawn + added ones.
    more = numbered(p.where("added > 0"), F.col("drawn") + F.col("added"))
    m = _big(F.col("_m"))
    hit = F.when(F.col("_line") > 0, crossed(m)).otherwise(F.lit(0)).cast("long")
    prior = F.when(F.col("_line") > 0, crossed(_big(F.col("_m") - 1))).otherwise(F.lit(0)).cast("long")
    more = more.where((hit == prior) & (F.col("_m") - hit <= F.col("added")))
    return steps.union(more.select("_q", "_t", "_k", F.col("_m").alias("_rank"), F.lit("floor").alias("drawn_as")))


def targeted_sample(
    records: DataFrame, targets: DataFrame, *, record: str, category: list[str], request: str, target: str, seed: str = "0", slice_rows: int = 500_000
) -> tuple[DataFrame, DataFrame]:
    """(sample, report): the sample has (request, target, record, drawn_as).

    ``records`` has one row per record with the ``category`` columns, ``record`` being unique and
    not null; ``targets`` has those columns and ``share_ppm``, ``min_rows`` and ``sample_size``.  Null
    equals null in a category.  A null share, minimum or size counts as 0.  Every target has a row
    in the report, also without records: ``needed`` (the larger of minimum and share rounded up),
    ``available``, ``missing`` (what the records cannot give), and the picks ``drawn`` by the line,
    ``added`` for the floor and ``paid`` for other floors.  Columns of ``targets`` named like these are
    replaced; further columns of ``records`` don't count.

    ``drawn_as`` is 'drawn' or 'floor'.  A category that holds fewer records than its share or floor
    gives all of them; what it lacks is not drawn elsewhere, which would push other shares off.
    Two targets of one request with the same category draw one after the other from the line and
    may pick the same record; the sample keeps it once for each target.  Empty tables give empty
    results.
    """
    ranked, available = ranked_records(records, record=record, category=category, seed=seed, slice_rows=slice_rows)
    plan = allocation(targets, available, category=category, request=request, target=target, seed=seed)
    picks = picked_ranks(plan, request=request, target=target)
    sample = picks.join(ranked, ["_k", "_rank"]).select(F.col("_q").alias(request), F.col("_t").alias(target), F.col("_r").alias(record), "drawn_as")
    return sample, plan.drop("_k", "_line", "_at")
