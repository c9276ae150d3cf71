"""Window, selection and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators.ranking import cum_before, sliced_rank, stratified_top, top_by, whole_groups_until
from pointgate.operators.valuation import lineup, replacement
from pointgate.plans.joins import _POINTS, points
from pointgate.plans.labels import _YEARLY, yearly
from pointgate.plans.registry import query
from pointgate.session import table

_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").alias("n"))


@query("cum_before", f"WITH d AS ({_DAILY}) SELECT user_id, day, round(coalesce(sum(v) OVER w, 0), 4) AS before, coalesce(sum(n) OVER w, 0)::BIGINT AS games FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def q_cum_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("_d", F.unix_date("day"))
    return d.select("user_id", "day", F.round(cum_before(F.col("v"), key=["user_id"], order="_d"), 4).alias("before"), cum_before(F.col("n"), key=["user_id"], order="_d").alias("games"))


SLOTS, FLEX = {"view": 2, "purchase": 1, "click": 2}, ["view", "click", "error"]
_WEEKLY = "SELECT user_id % 20 AS team, user_id, event_type AS pos, CAST(floor((epoch_us(ts) - 1704067200000000) / 604800000000) AS INTEGER) AS week, round(sum(value), 4) AS pts FROM events GROUP BY 1, 2, 3, 4"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    week = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 604_800_000_000).cast("int")
    return e.groupBy((F.col("user_id") % 20).alias("team"), "user_id", F.col("event_type").alias("pos"), week.alias("week")).agg(F.round(F.sum("value"), 4).alias("pts"))


_ROLES = """
r AS (SELECT *, row_number() OVER (PARTITION BY team, week, pos ORDER BY {order}) AS rk, CASE pos WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS need FROM {src}),
f AS (SELECT *, rk > need AND pos IN ('view', 'click', 'error') AS open FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY team, week, open ORDER BY {order}) AS fx FROM f),
s AS (SELECT *, CASE WHEN rk <= need THEN pos WHEN open AND fx <= 1 THEN 'FLEX' END AS role FROM g)
"""


@query("lineup_hindsight", f"WITH w AS ({_WEEKLY}), {_ROLES.format(order='pts DESC, user_id, pos', src='w')} SELECT team, week, round(sum(pts), 2) AS points, count(*) AS starters FROM s WHERE role IS NOT NULL GROUP BY 1, 2")
def lineup_hindsight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line-up of each week, seen from after it."""
    x = lineup(weekly(spark, sf_dir), by=["team", "week"], position="pos", order=[F.col("pts").desc(), "user_id", "pos"], slots=SLOTS, flex=FLEX, flex_slots=1)
    return x.groupBy("team", "week").agg(F.round(F.sum("pts"), 2).alias("points"), F.count("*").alias("starters"))


@query(
    "lineup_realistic",
    f"""WITH w0 AS ({_WEEKLY}), k AS (SELECT DISTINCT team, user_id, pos FROM w0), h AS (SELECT k.*, week FROM k, (SELECT DISTINCT week FROM w0)), x AS (SELECT h.*, coalesce(w0.pts, 0) AS pts FROM h LEFT JOIN w0 USING (team, user_id, pos, week)),
w AS (SELECT *, coalesce(round(sum(pts) OVER (PARTITION BY user_id, pos ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / nullif(week, 0), 6), 0) AS form FROM x), {_ROLES.format(order='form DESC, user_id, pos', src='w')}
SELECT team, week, round(sum(pts), 2) AS points, count(*) AS starters FROM s WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def lineup_realistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-up chosen by what was known before each week, scored by that week."""
    w = weekly(spark, sf_dir)
    weeks = w.select("week").distinct()  # a calendar of a few weeks
    grid = w.select("team", "user_id", "pos").distinct().crossJoin(F.broadcast(weeks))
    x = grid.join(w, ["team", "user_id", "pos", "week"], "left").withColumn("pts", F.coalesce("pts", F.lit(0.0)))
    before = Window.partitionBy("user_id", "pos").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("form", F.coalesce(F.round(F.try_divide(F.sum("pts").over(before), F.col("week")), 6), F.lit(0.0)))
    x = lineup(x, by=["team", "week"], position="pos", order=[F.col("form").desc(), "user_id", "pos"], slots=SLOTS, flex=FLEX, flex_slots=1)
    return x.groupBy("team", "week").agg(F.round(F.sum("pts"), 2).alias("points"), F.count("*").alias("starters"))


@query(
    "replacement_vorp",
    f"""WITH p AS ({_POINTS}), o AS (SELECT season, nflverse_id, max(position) AS position, max(total_ppr) AS v FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY v DESC, nflverse_id) AS rk, CASE position WHEN 'QB' THEN 4 WHEN 'RB' THEN 8 WHEN 'WR' THEN 8 WHEN 'TE' THEN 4 ELSE 0 END AS need FROM o),
f AS (SELECT *, rk > need AND position IN ('RB', 'WR', 'TE') AS rest FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY season, rest ORDER BY v DESC, nflverse_id) AS fx FROM f),
l AS (SELECT season, position, coalesce(max(CASE WHEN rk > need AND NOT (rest AND fx <= 4) THEN v END), min(v)) AS replacement FROM g GROUP BY 1, 2)
SELECT season, nflverse_id, position, round(replacement, 2) AS replacement, round(v - replacement, 2) AS vorp FROM o JOIN l USING (season, position)""",
)
def replacement_vorp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed value over the replacement level of season and position."""
    o = points(spark, sf_dir).groupBy("season", "nflverse_id").agg(F.max("position").alias("position"), F.max("total_ppr").alias("v"))
    level = replacement(o, by=["season"], position="position", value="v", id="nflverse_id", slots={"QB": 4, "RB": 8, "WR": 8, "TE": 4}, flex=["RB", "WR", "TE"], flex_slots=4)
    return o.join(level, ["season", "position"]).select("season", "nflverse_id", "position", F.round("replacement", 2).alias("replacement"), F.round(F.col("v") - F.col("replacement"), 2).alias("vorp"))


@query(
    "tercile_rollup",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS band, CAST(ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS INTEGER) AS tercile, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hit FROM orders),
g AS (SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, tercile, count(*) AS n, round(avg(hit), 6) AS rate, round(avg(o_totalprice), 2) AS mean FROM o GROUP BY GROUPING SETS ((band, tercile), (tercile)))
SELECT *, round(max(CASE WHEN tercile = 2 THEN rate END) OVER (PARTITION BY band) / nullif(max(CASE WHEN tercile = 0 THEN rate END) OVER (PARTITION BY band), 0), 6) AS ratio FROM g""",
)
def tercile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by band and tercile, an 'all' band, and the ratio of the outer terciles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("band"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("hit"))
    o = sliced_rank(o, by=["band"], value="o_totalprice", tie="o_orderkey", name="_r", size="_n", descending=False)
    # The first n % 3 parts hold one row more.
    more, part = F.col("_n") % 3, F.floor(F.col("_n") / 3)
    first = more * (part + 1)
    o = o.withColumn("tercile", F.when(F.col("_r") <= first, F.floor((F.col("_r") - 1) / (part + 1))).otherwise(more + F.floor((F.col("_r") - 1 - first) / F.greatest(part, F.lit(1)))).cast("int"))
    agg = [F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"), F.round(F.avg("o_totalprice"), 2).alias("mean")]
    g = o.groupingSets([["band", "tercile"], ["tercile"]], "band", "tercile").agg(F.grouping("band").alias("_all"), *agg)
    g = g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("band")).alias("band"), "tercile", "n", "rate", "mean")
    of = lambda t: F.max(F.when(F.col("tercile") == t, F.col("rate"))).over(Window.partitionBy("band"))
    return g.withColumn("ratio", F.round(F.try_divide(of(2), of(0)), 6))


@query(
    "sequence_windows",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY pos) > 1 AS repeated, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS top FROM e)
SELECT user_id, arg_min(event_type, pos) AS first_type, arg_max(event_type, pos) AS last_type, count_if(repeated) AS repeats, min(CASE WHEN repeated THEN pos END) AS first_repeat,
  max(CASE WHEN top = 2 THEN event_id END) AS second_best, count_if(pos <= 8 AND event_type = 'error') > 2 AS killed_early FROM d GROUP BY 1""",
)
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last of a sequence, repetitions within a day, the runner-up, an early stop on eight events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value", F.row_number().over(order).cast("long").alias("pos"))
    repeated = F.row_number().over(Window.partitionBy("user_id", "day", "event_type").orderBy("pos")) > 1
    top = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    d = e.withColumn("repeated", repeated).withColumn("top", top)
    return d.groupBy("user_id").agg(
        F.min_by("event_type", "pos").alias("first_type"), F.max_by("event_type", "pos").alias("last_type"), F.count_if("repeated").alias("repeats"), F.min(F.when(F.col("repeated"), F.col("pos"))).alias("first_repeat"),
        F.max(F.when(F.col("top") == 2, F.col("event_id"))).alias("second_best"), (F.count_if((F.col("pos") <= 8) & (F.col("event_type") == "error")) > 2).alias("killed_early"),
    )


@query(
    "first_divergence",
    """WITH a AS (SELECT season, player_id, row_number() OVER (PARTITION BY season ORDER BY min(adp), player_id) AS pos FROM draftbench WHERE preset = 'ppr' GROUP BY 1, 2), b AS (SELECT season, player_id, row_number() OVER (PARTITION BY season ORDER BY min(adp), player_id) AS pos FROM draftbench WHERE preset = 'standard' GROUP BY 1, 2)
SELECT a.season, min(CASE WHEN a.player_id <> b.player_id THEN pos END) AS first_divergence, count(*) AS compared FROM a JOIN b USING (season, pos) GROUP BY 1""",
)
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two ordered lists first differ."""

    def ranked(preset: str, name: str) -> DataFrame:
        d = table(spark, sf_dir, "draftbench").where(F.col("preset") == preset).groupBy("season", "player_id").agg(F.min("adp").alias("adp"))
        return d.select("season", F.col("player_id").alias(name), F.row_number().over(Window.partitionBy("season").orderBy("adp", "player_id")).cast("long").alias("pos"))

    x = ranked("ppr", "a").join(ranked("standard", "b"), ["season", "pos"])
    return x.groupBy("season").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("pos"))).alias("first_divergence"), F.count("*").alias("compared"))


@query(
    "group_split",
    """WITH g AS (SELECT lang, player_id AS grp, count(*) AS n FROM documents WHERE player_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT lang, greatest(1, floor(sum(n) * 0.1 + 0.5)) AS target FROM g GROUP BY 1)
SELECT coalesce(g.lang, '') AS lang, grp, n, CASE WHEN coalesce(sum(n) OVER (PARTITION BY g.lang ORDER BY sha256('17:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < target THEN 'dev' ELSE 'train' END AS split
FROM g JOIN t ON t.lang IS NOT DISTINCT FROM g.lang""",
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups in hash order go to dev until a tenth of the stratum's rows is reached."""
    d = table(spark, sf_dir, "documents").where(F.col("player_id").isNotNull())
    g = d.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.col("player_id").alias("grp")).agg(F.count("*").alias("n"))
    target = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy("lang")) * 0.1 + 0.5))
    x = whole_groups_until(g.withColumn("_target", target), stratum=["lang"], group="grp", size="n", key=F.sha2(F.concat(F.lit("17:"), "grp"), 256), target=F.col("_target"))
    return x.select("lang", "grp", "n", F.when(F.col("taken"), "dev").otherwise("train").alias("split"))


@query(
    "episode_split",
    """WITH c AS (SELECT DISTINCT c_mktsegment AS stratum, c_custkey FROM customer) SELECT stratum, c_custkey, CASE WHEN r <= 10 THEN 'train' WHEN r <= 12 THEN 'dev' ELSE 'heldout' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(stratum || '|' || c_custkey), c_custkey) AS r FROM c) WHERE r <= 15""",
)
def episode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen episodes per stratum by hash, split 10 / 2 / 3."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), "c_custkey").distinct()
    r = F.row_number().over(Window.partitionBy("stratum").orderBy(F.sha2(F.concat_ws("|", "stratum", F.col("c_custkey").cast("string")), 256), "c_custkey"))
    x = c.withColumn("r", r).where("r <= 15")
    return x.select("stratum", "c_custkey", F.when(F.col("r") <= 10, "train").when(F.col("r") <= 12, "dev").otherwise("heldout").alias("split"))


@query(
    "stratified_keep",
    """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders) SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (
SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM o) WHERE r <= floor(0.6::DOUBLE * n + 0.5)""",
)
def q_stratified_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return stratified_top(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_orderkey", 0.6).drop("o_totalprice")


@query("loss_mass", "SELECT source, lang, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source) * (SELECT count(*) FROM documents) * 0.25, 6) AS weight FROM (SELECT source, coalesce(lang, '') AS lang FROM documents) GROUP BY 1, 2")
def loss_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that give each cell its share of the schema's mass."""
    g = table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_all"))
    x = g.crossJoin(F.broadcast(total))
    return x.select("source", "lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")) * F.col("_all") * 0.25, 6).alias("weight"))


@query(
    "snake_order",
    """WITH g AS (SELECT t AS teams, s AS slot, r AS round FROM (VALUES (8), (10), (12), (14)) a(t), range(1, 15) b(s), range(1, 16) c(r) WHERE s <= t), p AS (SELECT CAST(teams AS BIGINT) AS teams, slot, round, CASE WHEN round % 2 = 1 THEN (round - 1) * teams + slot ELSE round * teams - slot + 1 END AS pick FROM g)
SELECT *, lead(pick) OVER (PARTITION BY teams, slot ORDER BY round) - pick AS wait, 15 - round AS picks_left, CAST((pick - 1) // teams + 1 AS BIGINT) AS on_clock_round FROM p""",
)
def snake_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of every slot in a snake draft, the wait until the next, and the picks left."""
    g = spark.range(1).select(F.explode(F.array(*[F.lit(t).cast("long") for t in (8, 10, 12, 14)])).alias("teams"))
    g = g.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("teams")))).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(15).cast("long"))))
    p = g.withColumn("pick", F.when(F.col("round") % 2 == 1, (F.col("round") - 1) * F.col("teams") + F.col("slot")).otherwise(F.col("round") * F.col("teams") - F.col("slot") + 1))
    wait = F.lead("pick").over(Window.partitionBy("teams", "slot").orderBy("round")) - F.col("pick")
    return p.select("teams", "slot", "round", "pick", wait.alias("wait"), (15 - F.col("round")).alias("picks_left"), (F.floor((F.col("pick") - 1) / F.col("teams")) + 1).alias("on_clock_round"))


@query(
    "sample_select",
    """WITH l AS (SELECT o_orderkey, o_orderpriority AS label, o_totalprice, sha256('9:' || o_orderkey) AS h FROM orders),
a AS (SELECT o_orderkey, 'quota' AS how FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY h) <= 3), b AS (SELECT o_orderkey, 'fill' AS how FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY h LIMIT 5),
c AS (SELECT o_orderkey, 'top' AS how FROM l ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), d AS (SELECT o_orderkey, 'bottom' AS how FROM l ORDER BY o_totalprice, o_orderkey LIMIT 5)
SELECT o_orderkey, how, scenario FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d), (VALUES ('base'), ('named'), ('masked'), ('swapped')) s(scenario)""",
)
def sample_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each label, five more by hash, five of either tail, each in four scenarios."""
    l = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"), "o_totalprice", F.sha2(F.concat(F.lit("9:"), F.col("o_orderkey")), 256).alias("h"))
    a = top_by(l, ["label"], ["h"], 3).select("o_orderkey", F.lit("quota").alias("how"), "h")
    b = l.join(a.select("o_orderkey"), "o_orderkey", "left_anti").orderBy("h").limit(5).select("o_orderkey", F.lit("fill").alias("how"), "h")
    c = l.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select("o_orderkey", F.lit("top").alias("how"), "h")
    d = l.orderBy("o_totalprice", "o_orderkey").limit(5).select("o_orderkey", F.lit("bottom").alias("how"), "h")
    return a.unionAll(b).unionAll(c).unionAll(d).select("o_orderkey", "how", F.explode(F.array(*map(F.lit, ("base", "named", "masked", "swapped")))).alias("scenario"))


@query(
    "recent_per_entity",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events QUALIFY n <= 3",
)
def recent_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest events of each user."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n")).where("n <= 3")


@query(
    "latest_snapshot",
    """WITH s AS (SELECT *, year(dt) AS season FROM depth_snapshot), m AS (SELECT team, season, max(dt) AS dt FROM s GROUP BY 1, 2)
SELECT s.gsis_id, s.season, min(pos_rank) AS rank, count(DISTINCT depth_id) AS rows FROM s JOIN m ON m.team = s.team AND m.season = s.season AND m.dt = s.dt GROUP BY 1, 2""",
)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in the last snapshot of each team and season."""
    s = table(spark, sf_dir, "depth_snapshot").withColumn("season", F.year("dt"))
    s = s.withColumn("_last", F.max("dt").over(Window.partitionBy("team", "season"))).where(F.col("dt") == F.col("_last"))
    return s.groupBy("gsis_id", "season").agg(F.min("pos_rank").alias("rank"), F.count_distinct("depth_id").alias("rows"))


@query(
    "injury_carry",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS played, max(CASE WHEN event_type = 'error' THEN event_id END) AS mark FROM events GROUP BY 1, 2),
s AS (SELECT *, sum(CASE WHEN played THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS session, count_if(played) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_played,
 count(*) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_days FROM c)
SELECT user_id, day, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id, session ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active, later_played = 0 AND later_days >= 3 AS ending FROM s""",
)
def injury_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark stays active until a played day clears it; it ends the season if none follows."""
    c = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("played"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("mark"))
    w = Window.partitionBy("user_id").orderBy("day")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    s = c.withColumn("session", F.sum(F.col("played").cast("int")).over(w)).withColumn("later_played", F.count_if("played").over(later)).withColumn("later_days", F.count("*").over(later))
    active = F.last("mark", ignorenulls=True).over(Window.partitionBy("user_id", "session").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("user_id", "day", active.alias("active"), ((F.col("later_played") == 0) & (F.col("later_days") >= 3)).alias("ending"))


@query(
    "league_rank_argmax",
    _YEARLY
    + """, m AS (SELECT *, max(total) OVER (PARTITION BY year, segment) AS best, (SELECT max(total) FROM y z WHERE z.year = y.year AND z.segment = y.segment AND z.custkey <> y.custkey) AS other FROM y)
SELECT year, segment, custkey, rank() OVER (PARTITION BY year, segment ORDER BY orders DESC) AS shared_rank, round(100 * total / other, 1) AS league_index, arg_max(custkey, (orders, -custkey)) OVER (PARTITION BY year, segment) AS leader FROM m""",
)
def league_rank_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that ties share, the index against the best of the others, and the leader by a tie rule."""
    y = yearly(spark, sf_dir)
    group = Window.partitionBy("year", "segment")
    second = F.max(F.when(F.col("rank") == 2, F.col("total"))).over(group)
    other = F.when(F.col("rank") == 1, second).otherwise(F.max("total").over(group))
    leader = F.max_by("custkey", F.struct("orders", -F.col("custkey"))).over(group)
    return y.select("year", "segment", "custkey", F.rank().over(group.orderBy(F.col("orders").desc())).alias("shared_rank"), F.round(F.try_divide(100 * F.col("total"), other), 1).alias("league_index"), leader.alias("leader"))
