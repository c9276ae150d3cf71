"""Scores, calibration, lift, resampling, profiles and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators import metrics as m
from pointgate.operators import scoring as sc
from pointgate.operators.nearest import cosine_topk
from pointgate.operators.ranking import quantiles, sliced_rank
from pointgate.plans.labels import _YEARLY, yearly
from pointgate.plans.registry import query
from pointgate.session import table

_LABELLED = """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS family, year(l_shipdate) AS season, least(greatest(l_quantity / 60.0 + l_discount, 0.02), 0.98) AS p, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as judgments: a probability from quantity and discount, an outcome from the status."""
    p = F.least(F.greatest(F.col("l_quantity") / 60.0 + F.col("l_discount"), F.lit(0.02)), F.lit(0.98))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("family"), F.year("l_shipdate").alias("season"), p.alias("p"), (F.col("l_linestatus") == "F").cast("int").alias("y")
    )


_SCORES = "count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)), 6) AS log_loss"


@query("brier_logloss", f"SELECT season, {_SCORES}, round(avg((0.5 - y) * (0.5 - y)), 6) AS coin FROM ({_LABELLED}) GROUP BY 1")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return labelled(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), F.round(m.brier(p, y), 6).alias("brier"), F.round(m.log_loss(p, y), 6).alias("log_loss"), F.round(m.brier(F.lit(0.5), y), 6).alias("coin"))


@query(
    "reliability_ece",
    f"""WITH l AS ({_LABELLED}), b AS (SELECT family, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS f FROM l GROUP BY 1, 2), g AS (SELECT DISTINCT family, CAST(i AS INTEGER) AS bin FROM l, range(10) r(i)),
t AS (SELECT g.family, g.bin, coalesce(n, 0) AS n, mp, f FROM g LEFT JOIN b USING (family, bin))
SELECT family, bin, n, round(mp, 4) AS mean_p, round(f, 4) AS freq, round(sum(abs(round(mp, 4) - round(f, 4)) * n) OVER (PARTITION BY family) / sum(n) OVER (PARTITION BY family), 6) AS ece FROM t""",
)
def reliability_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = m.reliability(labelled(spark, sf_dir), "p", "y", ["family"])
    ece = m.calibration_error(bins, ["family"])
    return bins.join(ece, "family").select("family", "bin", "n", F.round("mean_p", 4).alias("mean_p"), F.round("freq", 4).alias("freq"), F.round("ece", 6).alias("ece"))


@query("rollup_metrics", f"SELECT coalesce(family, 'all') AS family, coalesce(CAST(season AS VARCHAR), 'all') AS season, {_SCORES} FROM ({_LABELLED}) GROUP BY ROLLUP (family, season)")
def rollup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    x = labelled(spark, sf_dir).rollup("family", "season").agg(F.count("*").alias("n"), F.round(m.brier(p, y), 6).alias("brier"), F.round(m.log_loss(p, y), 6).alias("log_loss"))
    return x.select(F.coalesce("family", F.lit("all")).alias("family"), F.coalesce(F.col("season").cast("string"), F.lit("all")).alias("season"), "n", "brier", "log_loss")


@query(
    "topk_lift",
    f"""WITH l AS ({_LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM l)
SELECT season, sum(CASE WHEN k <= 10 THEN y ELSE 0 END)::BIGINT AS hits, round(avg(y) * least(10, count(*)), 6) AS expected, round(sum(CASE WHEN k <= 10 THEN y ELSE 0 END) / nullif(avg(y) * least(10, count(*)), 0), 6) AS lift FROM r GROUP BY 1""",
)
def topk_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among the ten highest probabilities of a season against its base rate."""
    l = labelled(spark, sf_dir)
    base = l.groupBy("season").agg(F.avg("y").alias("rate"), F.count("*").alias("n"))
    top = l.withColumn("k", F.row_number().over(Window.partitionBy("season").orderBy(F.col("p").desc(), "l_orderkey", "l_linenumber", "l_partkey"))).where("k <= 10").groupBy("season").agg(F.sum("y").alias("hits"))
    expected = F.col("rate") * F.least(F.lit(10), F.col("n"))
    return base.join(top, "season").select("season", "hits", F.round(expected, 6).alias("expected"), F.round(F.try_divide(F.col("hits"), expected), 6).alias("lift"))


_CLAIMS = """SELECT doc_id, source, coalesce(lang, '') AS lang, CASE WHEN internal_research_only THEN 1 ELSE 0 END AS hit, list_filter([CASE WHEN regexp_matches(lower(text), 'sore|missed|limited by') THEN 'injury' END, CASE WHEN regexp_matches(lower(text), 'drafters|pick ') THEN 'price' END, CASE WHEN regexp_matches(lower(text), 'moved|ahead of') THEN 'role' END], lambda x: x IS NOT NULL) AS claims FROM documents"""


@query(
    "claim_lift_sets",
    f"""WITH c AS ({_CLAIMS}), u AS (SELECT source, claim, hit, list_contains(claims, claim) AS said FROM c, (VALUES ('injury'), ('price'), ('role')) k(claim)),
g AS (SELECT coalesce(source, 'all') AS source, claim, count_if(coalesce(said, false)) AS n_c, count_if(said AND hit = 1) AS k_c, count_if(NOT coalesce(said, false)) AS n_u, count_if(NOT coalesce(said, false) AND hit = 1) AS k_u FROM u GROUP BY GROUPING SETS ((source, claim), (claim)))
SELECT *, CASE WHEN n_c > 0 AND n_u > 0 AND k_u > 0 THEN round((k_c / n_c) / (k_u / n_u), 6) END AS lift FROM g""",
)
def claim_lift_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed against unclaimed documents, by source and pooled; null where a denominator is 0."""
    t = F.lower(F.coalesce("text", F.lit("")))
    lexicon = {"injury": "sore|missed|limited by", "price": "drafters|pick ", "role": "moved|ahead of"}
    d = table(spark, sf_dir, "documents").select("source", F.coalesce("internal_research_only", F.lit(False)).alias("hit"), F.explode(F.array(*[F.struct(F.lit(k).alias("claim"), t.rlike(v).alias("said")) for k, v in lexicon.items()])).alias("x"))
    said, hit = F.col("said"), F.col("hit")
    g = d.select("source", "hit", "x.*").groupingSets([["source", "claim"], ["claim"]], "source", "claim").agg(
        F.count_if(said).alias("n_c"), F.count_if(said & hit).alias("k_c"), F.count_if(~said).alias("n_u"), F.count_if(~said & hit).alias("k_u")
    )
    lift = F.when((F.col("n_c") > 0) & (F.col("n_u") > 0) & (F.col("k_u") > 0), F.round((F.col("k_c") / F.col("n_c")) / (F.col("k_u") / F.col("n_u")), 6))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), "claim", "n_c", "k_c", "n_u", "k_u", lift.alias("lift"))


_CELLS = f"SELECT season, season * 12 AS _x, count(*) AS n, sum((p - y) * (p - y)) AS s, sum((0.5 - y) * (0.5 - y)) AS c, row_number() OVER (ORDER BY season) - 1 AS pos FROM ({_LABELLED}) GROUP BY 1"
_DRAWS = "SELECT rep, c.pos, CAST('0x' || substr(md5('{seed}:' || rep || ':' || c.pos), 1, 8) AS BIGINT) % (SELECT count(*) FROM c) AS pick FROM c, range(1, {reps}) r(rep)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per season with the sums that a score needs: rows are never resampled."""
    l = labelled(spark, sf_dir)
    g = l.groupBy("season").agg(F.count("*").alias("n"), F.sum((F.col("p") - F.col("y")) ** 2).alias("s"), F.sum((0.5 - F.col("y")) ** 2).alias("c"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy("season")) - 1)


def resampled(spark: SparkSession, sf_dir: str, reps: int, seed: str) -> DataFrame:
    c = cells(spark, sf_dir)
    draws = m.resample_draws(c.select("pos"), reps, seed)
    return draws.join(F.broadcast(c.select(F.col("pos").cast("long").alias("pick"), "n", "s", "c")), "pick")


@query(
    "bootstrap_ci",
    f"""WITH c AS ({_CELLS}), d AS ({_DRAWS.format(seed='boot', reps=1001)}), r AS (SELECT rep, sum(c.s) / sum(c.n) AS v FROM d JOIN c ON c.pos = d.pick GROUP BY 1), o AS (SELECT list_sort(list(v)) AS vs FROM r)
SELECT 1000 AS reps, round(vs[CAST(floor(0.025::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 6) AS low, round(vs[CAST(floor(0.975::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 6) AS high FROM o""",
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the pooled score, seasons resampled with replacement."""
    r = resampled(spark, sf_dir, 1000, "boot").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("v"))
    return r.agg(F.count("*").cast("int").alias("reps"), F.round(m.index_percentile(F.col("v"), 0.025), 6).alias("low"), F.round(m.index_percentile(F.col("v"), 0.975), 6).alias("high"))


@query(
    "paired_bootstrap",
    f"""WITH c AS ({_CELLS}), d AS ({_DRAWS.format(seed='pair', reps=1001)}), r AS (SELECT rep, (sum(c.s) - sum(c.c)) / sum(c.n) AS v FROM d JOIN c ON c.pos = d.pick GROUP BY 1), o AS (SELECT list_sort(list(v)) AS vs, avg(v) AS mean FROM r),
x AS (SELECT round(mean, 6) AS mean, round(vs[CAST(floor(0.025::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 6) AS low, round(vs[CAST(floor(0.975::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 6) AS high FROM o)
SELECT *, CASE WHEN high < 0 THEN 'yes' WHEN low > 0 THEN 'no' ELSE 'unresolved' END AS better FROM x""",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two forecasters under the same draws."""
    r = resampled(spark, sf_dir, 1000, "pair").groupBy("rep").agg(((F.sum("s") - F.sum("c")) / F.sum("n")).alias("v"))
    x = r.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(m.index_percentile(F.col("v"), 0.025), 6).alias("low"), F.round(m.index_percentile(F.col("v"), 0.975), 6).alias("high"))
    return x.withColumn("better", F.when(F.col("high") < 0, "yes").when(F.col("low") > 0, "no").otherwise("unresolved"))


@query(
    "corr_residual",
    """WITH l AS (SELECT l_shipdate, l_quantity AS x, l_extendedprice AS y, l_tax AS z, year(l_shipdate) < 1995 AS early FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), r AS (SELECT early, x, y, z, y - (a + b * x) AS res FROM l, f)
SELECT CASE WHEN grouping(early) = 1 THEN 'all' WHEN early THEN 'early' ELSE 'late' END AS era, count(*) AS n, round(corr(x, y), 6) AS r, round(corr(res, z), 6) AS partial FROM r GROUP BY GROUPING SETS ((early), ())""",
)
def corr_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, and that of what a line fit leaves, per era and pooled."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("z"), (F.year("l_shipdate") < 1995).alias("early"))
    fit = l.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    r = l.crossJoin(F.broadcast(fit)).select("early", "x", "y", "z", (F.col("y") - (F.col("a") + F.col("b") * F.col("x"))).alias("res"))
    g = r.groupingSets([["early"], []], "early").agg(F.grouping("early").alias("_all"), F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr("x", "y"), 6)).alias("r"), F.when(F.count("*") >= 3, F.round(F.corr("res", "z"), 6)).alias("partial"))
    return g.select(F.when(F.col("_all") == 1, "all").when(F.col("early"), "early").otherwise("late").alias("era"), "n", "r", "partial")


@query(
    "bucket_quartiles",
    "SELECT date_trunc('quarter', l_shipdate) AS bucket, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem GROUP BY 1",
)
def bucket_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.date_trunc("quarter", "l_shipdate").cast("timestamp_ntz").alias("bucket"), F.col("l_extendedprice").alias("v"))
    means = x.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    q = quantiles(x, by=["bucket"], value="v", at={"median": 0.5, "p25": 0.25, "p75": 0.75})
    return means.join(q.withColumnRenamed("bucket", "_b"), F.col("bucket").eqNullSafe(F.col("_b")), "left").select("bucket", "n", "mean", *[F.round(c, 4).alias(c) for c in ("median", "p25", "p75")])


_KNOTS = "SELECT preset, CAST(least(floor(adp / 10), 17) AS INTEGER) AS slot, avg(prev_points) AS v, count(*) AS n FROM draftbench WHERE adp IS NOT NULL AND NOT isnan(adp) AND prev_points IS NOT NULL GROUP BY 1, 2"


@query(
    "isotonic_curve",
    f"""WITH k AS ({_KNOTS}), m AS (SELECT a.preset, a.slot AS a, b.slot AS b, (SELECT sum(v * n) / sum(n) FROM k c WHERE c.preset = a.preset AND c.slot BETWEEN a.slot AND b.slot) AS mean FROM k a JOIN k b ON a.preset = b.preset AND a.slot <= b.slot),
f AS (SELECT i.preset, i.slot, m.a, max(mean) AS mx FROM k i JOIN m ON m.preset = i.preset AND m.a <= i.slot AND m.b >= i.slot GROUP BY 1, 2, 3), x AS (SELECT preset, slot, min(mx) AS fit FROM f GROUP BY 1, 2)
SELECT preset, slot, greatest(round(fit, 2), 0) AS price FROM x""",
)
def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price that never rises with the slot: the weighted isotonic fit of bucket means, not below 0."""
    d = table(spark, sf_dir, "draftbench").where(F.nanvl("adp", F.lit(None)).isNotNull() & F.col("prev_points").isNotNull())
    k = d.groupBy("preset", F.least(F.floor(F.col("adp") / 10), F.lit(17)).cast("int").alias("slot")).agg(F.avg("prev_points").alias("v"), F.count("*").alias("n"))
    fit = m.isotonic_decreasing(k, by=["preset"], x="slot", value="v", weight="n")
    return fit.select("preset", "slot", F.greatest(F.round("fit", 2), F.lit(0.0)).alias("price"))


_CDF = "0.5 * (1 + CASE WHEN z >= 0 THEN 1 ELSE -1 END * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0)))))"


@query(
    "survival_timing",
    f"""WITH b AS (SELECT DISTINCT season, preset, player_id, adp, CASE WHEN stdev IS NULL OR isnan(stdev) OR stdev <= 0 THEN greatest(1, 0.15 * adp) ELSE greatest(1, stdev) END AS sd, prev_points FROM draftbench WHERE adp IS NOT NULL),
z AS (SELECT *, (adp - 60.0) / sd AS z FROM b), t AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs(z) / sqrt(2.0)) AS t FROM z)
SELECT season, preset, player_id, adp, round({_CDF}, 4) AS survival, round(({_CDF}) * prev_points - greatest(0, 180 - adp) / 2, 3) AS timing FROM t""",
)
def survival_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a player is still there at pick 60, and what waiting is worth."""
    d = table(spark, sf_dir, "draftbench").where(F.col("adp").isNotNull()).select("season", "preset", "player_id", "adp", "stdev", "prev_points")
    sd = F.when(F.coalesce(F.nanvl("stdev", F.lit(None)), F.lit(0.0)) <= 0, F.greatest(F.lit(1.0), 0.15 * F.col("adp"))).otherwise(F.greatest(F.lit(1.0), F.col("stdev")))
    x = d.select("season", "preset", "player_id", "adp", sd.alias("sd"), "prev_points").distinct().withColumn("s", sc.normal_cdf((F.col("adp") - 60.0) / F.col("sd")))
    return x.select("season", "preset", "player_id", "adp", F.round("s", 4).alias("survival"), F.round(F.col("s") * F.col("prev_points") - F.greatest(F.lit(0.0), 180 - F.col("adp")) / 2, 3).alias("timing"))


@query(
    "trimmed_stats",
    """WITH r AS (SELECT o_orderpriority AS arm, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT arm, max(n) AS n, round(avg(CASE WHEN r > n // 10 AND r <= n - n // 10 THEN v END), 4) AS trimmed, round(median(v), 4) AS median, round((sum(v) - max(v)) / (count(*) - 1), 4) AS without_max,
  CAST(ceil(power(2.8, 2) * var_samp(v) / power(avg(v), 2)) AS BIGINT) AS power_n FROM r GROUP BY 1""",
)
def trimmed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed mean, median, mean without the largest, and the sample size for 80 % power."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").alias("v"), "o_orderkey")
    r = sliced_rank(o, by=["arm"], value="v", tie="o_orderkey", name="r", size="n", descending=False)
    less = F.floor(F.col("n") / 10)
    kept = F.when((F.col("r") > less) & (F.col("r") <= F.col("n") - less), F.col("v"))
    middle = F.avg(F.when(F.col("r").between(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)), F.col("v")))
    return r.groupBy("arm").agg(
        F.max("n").alias("n"), F.round(F.avg(kept), 4).alias("trimmed"), F.round(middle, 4).alias("median"), F.round((F.sum("v") - F.max("v")) / (F.count("*") - 1), 4).alias("without_max"),
        F.ceil(2.8 * 2.8 * F.var_samp("v") / F.pow(F.avg("v"), F.lit(2))).alias("power_n"),
    )


@query(
    "avg_precision",
    f"""WITH l AS ({_LABELLED}), r AS (SELECT family, y, row_number() OVER w AS r, sum(y) OVER w AS h FROM (SELECT *, l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey AS tie FROM l) WINDOW w AS (PARTITION BY family ORDER BY p DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT family, round(avg(h / r), 6) AS average_precision FROM r WHERE y = 1 GROUP BY 1""",
)
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = labelled(spark, sf_dir).withColumn("tie", F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey"))
    return m.average_precision(l, "p", "y", "tie", ["family"]).select("family", F.round("average_precision", 6).alias("average_precision"))


@query(
    "usage_rollup",
    """WITH u AS (SELECT l_partkey, year(l_shipdate) AS year, sum(l_quantity) AS q, count(*) AS n, count(DISTINCT month(l_shipdate)) AS months, count_if(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2)
SELECT a.l_partkey, a.year, round(a.q, 2) AS q, a.n, a.months, a.returned, round(a.q / nullif(a.months, 0), 4) AS per_month, round((3 * coalesce(a.q, 0) + 2 * coalesce(b.q, 0) + coalesce(c.q, 0)) / 6, 4) AS weighted,
  round((a.q + coalesce(b.q, 0) + coalesce(c.q, 0)) / (1 + CAST(b.q IS NOT NULL AS INTEGER) + CAST(c.q IS NOT NULL AS INTEGER)), 4) AS trailing3
FROM u a LEFT JOIN u b ON b.l_partkey = a.l_partkey AND b.year = a.year - 1 LEFT JOIN u c ON c.l_partkey = a.l_partkey AND c.year = a.year - 2""",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly usage of a part, weighted 3 / 2 / 1 over three years, and their plain mean; gaps stay gaps."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.count_distinct(F.month("l_shipdate")).alias("months"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    by = Window.partitionBy("l_partkey").orderBy("year")
    at = lambda k: F.max("q").over(by.rangeBetween(-k, -k))
    zero = F.lit(0.0)
    return u.select(
        "l_partkey", "year", F.round("q", 2).alias("q"), "n", "months", "returned", F.round(F.try_divide("q", "months"), 4).alias("per_month"),
        F.round((3 * F.col("q") + 2 * F.coalesce(at(1), zero) + F.coalesce(at(2), zero)) / 6, 4).alias("weighted"), F.round(F.avg("q").over(by.rangeBetween(-2, 0)), 4).alias("trailing3"),
    )


@query(
    "rank_gap_score",
    _YEARLY
    + """, x AS (SELECT y.year, y.custkey, y.rank AS actual, a.rank AS consensus, row_number() OVER (PARTITION BY y.year ORDER BY coalesce(a.rank, 1000), y.custkey) AS ranked FROM y LEFT JOIN y a ON a.custkey = y.custkey AND a.year = y.year - 1 WHERE y.segment = 'BUILDING')
SELECT year, round(sum(abs(ranked - actual) * CASE WHEN actual <= 18 THEN 1.0::DOUBLE WHEN actual >= 30 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE - 0.5 * (actual - 18) / 12.0 END), 4) AS gap, count(*) AS n FROM x WHERE actual <= 50 GROUP BY 1""",
)
def rank_gap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted gap between a ranking and the outcome; the weight falls from 1 to .5 between ranks 18 and 30."""
    y = yearly(spark, sf_dir).where("segment = 'BUILDING'")
    before = y.select((F.col("year") + 1).alias("year"), "custkey", F.col("rank").alias("consensus"))
    x = y.join(before, ["year", "custkey"], "left")
    ranked = F.row_number().over(Window.partitionBy("year").orderBy(F.coalesce("consensus", F.lit(1000)), "custkey"))
    a = F.col("rank")
    weight = F.when(a <= 18, 1.0).when(a >= 30, 0.5).otherwise(1.0 - 0.5 * (a - 18) / 12.0)
    x = x.withColumn("ranked", ranked).where(a <= 50)
    return x.groupBy("year").agg(F.round(F.sum(F.abs(F.col("ranked") - a) * weight), 4).alias("gap"), F.count("*").alias("n"))


@query(
    "cell_pool_eras",
    f"""WITH c AS (SELECT season, family, count(*) AS n, sum((p - y) * (p - y)) AS s, sum(y) AS k FROM ({_LABELLED}) GROUP BY 1, 2), e AS (SELECT *, CASE WHEN season < 1995 THEN 'early' ELSE 'late' END AS era FROM c)
SELECT coalesce(era, 'all') AS era, coalesce(family, 'all') AS family, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS brier, round(sum(k) / sum(n), 6) AS base_rate, round((sum(k) / sum(n)) * (1 - sum(k) / sum(n)), 6) AS reference FROM e GROUP BY CUBE (era, family)""",
)
def cell_pool_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable cells pooled by era and family; the reference forecaster is the base rate."""
    c = labelled(spark, sf_dir).groupBy("season", "family").agg(F.count("*").alias("n"), F.sum((F.col("p") - F.col("y")) ** 2).alias("s"), F.sum("y").alias("k"))
    e = c.withColumn("era", F.when(F.col("season") < 1995, "early").otherwise("late")).cube("era", "family")
    rate = F.sum("k") / F.sum("n")
    x = e.agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("brier"), F.round(rate, 6).alias("base_rate"), F.round(rate * (1 - rate), 6).alias("reference"))
    return x.select(F.coalesce("era", F.lit("all")).alias("era"), F.coalesce("family", F.lit("all")).alias("family"), "n", "brier", "base_rate", "reference")


@query(
    "distribution_profile",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.95), 4) AS p95, round(100.0 * count(value) / count(*), 2) AS coverage, round(sum(value) * 0.003, 4) AS cost,
  count_if(value >= 100) AS tier1, count_if(value >= 50 AND value < 100) AS tier2, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM events GROUP BY 1""",
)
def distribution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), table(spark, sf_dir, "events")
    q = quantiles(e, by=["event_type"], value="value", at={"p5": 0.05, "p95": 0.95}).withColumnRenamed("event_type", "_e")
    x = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count("value") / F.count("*"), 2).alias("coverage"), F.round(F.sum("value") * 0.003, 4).alias("cost"),
        F.count_if(v >= 100).alias("tier1"), F.count_if((v >= 50) & (v < 100)).alias("tier2"), F.round(F.avg(F.when(v >= 50, 1.0).otherwise(0.0)), 6).alias("consistency"),
    )
    return x.join(q, F.col("event_type").eqNullSafe(F.col("_e")), "left").select(*x.columns, F.round("p5", 4).alias("p5"), F.round("p95", 4).alias("p95"))


@query(
    "band_audit",
    f"""WITH l AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS band, y, l_orderkey % 5 <> 0 AS kept FROM ({_LABELLED})), g AS (SELECT band, count(*) AS n, avg(y) AS pre, count_if(kept) AS n_kept, avg(CASE WHEN kept THEN y END) AS post FROM l GROUP BY 1)
SELECT band, n, n_kept, round(pre, 6) AS pre, round(post, 6) AS post, n_kept >= 5 AND abs(post - pre) > 2 * sqrt(pre * (1 - pre) / n_kept) AS flagged FROM g""",
)
def band_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rates before and after a filter, per probability band, flagged beyond two standard errors."""
    l = labelled(spark, sf_dir).select(m.decile(F.col("p")).alias("band"), "y", (F.col("l_orderkey") % 5 != 0).alias("kept"))
    g = l.groupBy("band").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.avg("y").alias("pre"), F.avg(F.when(F.col("kept"), F.col("y"))).alias("post"))
    se = F.sqrt(F.col("pre") * (1 - F.col("pre")) / F.col("n_kept"))
    return g.select("band", "n", "n_kept", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), ((F.col("n_kept") >= 5) & (F.abs(F.col("post") - F.col("pre")) > 2 * se)).alias("flagged"))


@query(
    "classifier_metrics",
    """WITH c AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 250000 THEN 'P' WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'F' ELSE 'O' END AS p FROM orders), k AS (SELECT DISTINCT y AS cls FROM c),
s AS (SELECT cls, count_if(y = cls AND p = cls) AS tp, count_if(y <> cls AND p = cls) AS fp, count_if(y = cls AND p <> cls) AS fn FROM c, k GROUP BY 1)
SELECT cls, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM c), 6) AS accuracy, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)) OVER (), 6) AS macro_f1 FROM s""",
)
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class counts, precision, recall and F1 from the confusion counts; accuracy and macro F1."""
    o = table(spark, sf_dir, "orders")
    p = F.when(F.col("o_totalprice") > 250000, "P").when(F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz"), "F").otherwise("O")
    c = o.groupBy(F.col("o_orderstatus").alias("y"), p.alias("p")).agg(F.count("*").alias("n"))  # the confusion matrix
    seen = c.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("true"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("said"))
    s = seen.join(said, "cls", "left").select("cls", "tp", (F.coalesce("said", F.lit(0)) - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.try_divide(2 * tp, 2 * tp + fp + fn)
    all_ = Window.partitionBy()  # one row a class
    return s.select("cls", "tp", "fp", "fn", F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(f1, 6).alias("f1"),
        F.round(F.sum("tp").over(all_) / F.sum(tp + fn).over(all_), 6).alias("accuracy"), F.round(F.avg(f1).over(all_), 6).alias("macro_f1"))


@query("pivot_summary", "SELECT o_orderpriority AS agent, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f_mean, round(stddev_samp(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f_std, count_if(o_orderstatus = 'F') AS f_n, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o_mean, round(stddev_samp(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o_std, count_if(o_orderstatus = 'O') AS o_n FROM orders GROUP BY 1")
def pivot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("agent")).pivot("o_orderstatus", ["F", "O"])
    x = x.agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 2).alias("std"), F.count(F.lit(1)).alias("n"))
    return x.select("agent", *[F.col(f"{s}_{c}").alias(f"{s.lower()}_{c}") if c != "n" else F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s.lower()}_n") for s in ("F", "O") for c in ("mean", "std", "n")])


@query(
    "constraint_audit",
    """SELECT 'orders_key' AS check_name, count(*) - count(DISTINCT o_orderkey) AS violations FROM orders UNION ALL SELECT 'lineitem_orphans', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customer_orphans', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'negative_quantity', count(*) FROM lineitem WHERE l_quantity <= 0
UNION ALL SELECT 'season_points_copies', count(*) - count(DISTINCT (season, player_id)) FROM season_points UNION ALL SELECT 'sealed_seasons', count(*) FROM draftbench WHERE season > 2023 UNION ALL SELECT 'split_in_two', count(*) FROM (SELECT trace_id FROM t11_targeted_v1 GROUP BY 1 HAVING count(DISTINCT split_name) > 1)""",
)
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of uniqueness, references, ranges and disjointness, one row a check."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda name, df, c: df.agg(c.alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    o, l = t("orders"), t("lineitem")
    checks = [
        one("orders_key", o, F.count("*") - F.count_distinct("o_orderkey")),
        one("lineitem_orphans", l.join(o, l.l_orderkey == o.o_orderkey, "left_anti"), F.count("*")),
        one("customer_orphans", o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), F.count("*")),
        one("negative_quantity", l.where("l_quantity <= 0"), F.count("*")),
        one("season_points_copies", t("season_points"), F.count("*") - F.count_distinct(F.struct("season", "player_id"))),
        one("sealed_seasons", t("draftbench").where("season > 2023"), F.count("*")),
        one("split_in_two", t("t11_targeted_v1").groupBy("trace_id").agg(F.count_distinct("split_name").alias("n")).where("n > 1"), F.count("*")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


@query("training_summary", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, list_sort(list(value))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of a series and its 95th percentile by index."""
    at = F.struct("ts", "event_id")
    v = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    ends = v.groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    p95 = quantiles(v, by=["user_id"], value="value", at={"p95": 0.95}, interpolate=False)
    return ends.join(p95.withColumnRenamed("user_id", "_u"), F.col("user_id").eqNullSafe(F.col("_u"))).select("user_id", "first_value", "last_value", "p95")


@query("embedding_topk", "WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label = q.label QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 7) DESC, e.vec_id) <= 5")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of the same label, for every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("_norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), F.col("_norm").alias("_qn"), "label")
    x = e.join(q, "label").where(F.col("vec_id") != F.col("query_id"))
    x = x.select("query_id", "vec_id", (dot(F.col("_q"), F.col("embedding")) / (F.col("_qn") * F.col("_norm"))).alias("s"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("s", 7).desc(), "vec_id"))
    return x.withColumn("r", r).where("r <= 5").select("query_id", "vec_id", F.round("s", 5).alias("similarity"))


@query("embedding_topk_all", "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 7) DESC, e.vec_id) <= 5")
def embedding_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of all vectors, of any label or none, for every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = cosine_topk(e.where(F.col("vec_id") % 20 == 0), e, id="vec_id", vector="embedding", k=5)
    return x.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))
