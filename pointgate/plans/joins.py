"""Joins: tie-broken, as-of, interval, cohort, anti, cascade and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.functions import text as tx
from pointgate.functions.names import NORM_NAME_SQL, norm_name
from pointgate.operators.matching import band_cohort, greedy_disjoint, tiebreak_join, tolerance_pairs, unambiguous
from pointgate.operators.near import edit_pairs
from pointgate.operators.temporal import asof_latest, carry_forward
from pointgate.plans.labels import _PF, _YEARLY, latest_packets, yearly
from pointgate.plans.registry import query
from pointgate.session import table

_BOARD = "SELECT DISTINCT season, preset, player_id, name, position, upper(team) AS team, adp, times_drafted, prev_points FROM draftbench"
_POINTS = "SELECT DISTINCT season, player_id AS nflverse_id, player, position, team AS teams, total_ppr, games FROM season_points"


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "draftbench")
    return d.select("season", "preset", "player_id", "name", "position", F.upper("team").alias("team"), "adp", "times_drafted", "prev_points").distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "season_points")
    return s.select("season", F.col("player_id").alias("nflverse_id"), "player", "position", F.col("team").alias("teams"), "total_ppr", "games").distinct()


@query(
    "tiebreak_join",
    f"""
WITH b AS (SELECT *, {NORM_NAME_SQL.format("name")} AS norm FROM ({_BOARD})), p AS (SELECT *, {NORM_NAME_SQL.format("player")} AS norm FROM ({_POINTS}))
SELECT season, preset, player_id, adp, nflverse_id, round(total_ppr, 2) AS total_ppr FROM b LEFT JOIN p USING (season, norm, position)
QUALIFY row_number() OVER (PARTITION BY season, preset, player_id, adp, name, b.team, times_drafted, prev_points ORDER BY coalesce(list_contains(string_split(p.teams, '/'), b.team), false) DESC, nflverse_id) = 1""",
)
def q_tiebreak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board ⋈ season by name and position; of several the one of the same team."""
    b = board(spark, sf_dir).withColumn("norm", norm_name(F.col("name")))
    p = points(spark, sf_dir).withColumn("norm", norm_name(F.col("player")))
    same = F.coalesce(F.array_contains(F.split("teams", "/"), F.col("team")), F.lit(False))
    ids = ["season", "preset", "player_id", "adp", "name", "team", "times_drafted", "prev_points"]
    x = tiebreak_join(b, p, ["season", "norm", "position"], left_id=ids, prefer=[same.desc(), F.col("nflverse_id").asc_nulls_last()])
    return x.select("season", "preset", "player_id", "adp", "nflverse_id", F.round("total_ppr", 2).alias("total_ppr"))


@query(
    "coalesce_join",
    f"""
WITH p AS (SELECT DISTINCT player_id, player FROM {_PF} WHERE player_id IS NOT NULL), u AS (SELECT player, min(player_id) AS pid FROM p GROUP BY 1 HAVING count(*) = 1), i AS (SELECT DISTINCT player_id FROM p)
SELECT doc_id, coalesce(i.player_id, u.pid) AS resolved, CASE WHEN i.player_id IS NOT NULL THEN 'id' WHEN u.pid IS NOT NULL THEN 'name' ELSE 'none' END AS how
FROM documents d LEFT JOIN i USING (player_id) LEFT JOIN u ON u.player = d.player_name""",
)
def coalesce_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, else by name where the name is unambiguous."""
    p = latest_packets(spark, sf_dir).where(F.col("player_id").isNotNull()).select("player_id", "player").distinct()
    names = unambiguous(p, ["player"]).select(F.col("player").alias("player_name"), F.col("player_id").alias("pid"))
    ids = p.select("player_id", F.lit(True).alias("_known")).distinct()
    x = table(spark, sf_dir, "documents").select("doc_id", "player_id", "player_name").join(ids, "player_id", "left").join(names, "player_name", "left")
    by_id = F.when(F.col("_known"), F.col("player_id"))
    return x.select("doc_id", F.coalesce(by_id, "pid").alias("resolved"), F.when(by_id.isNotNull(), "id").when(F.col("pid").isNotNull(), "name").otherwise("none").alias("how"))


@query(
    "asof_latest",
    """
SELECT p.event_id, p.user_id, e.ts AS error_ts, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON e.user_id = p.user_id AND e.ts < p.ts
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts DESC NULLS LAST) = 1""",
)
def q_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of the user strictly before each purchase."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("error_id")).withColumnRenamed("ts", "error_ts")
    x = asof_latest(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), errors, key=["user_id"], time="ts", right_time="error_ts", payload=["error_id"])
    return x.select("event_id", "user_id", F.col("asof_error_ts").alias("error_ts"), F.col("asof_error_id").alias("error_id"))


@query(
    "asof_carry_forward",
    """
WITH x AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS last_signup,
  first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_signup FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, coalesce(last_signup, first_signup) AS signup FROM x WHERE event_type = 'purchase'""",
)
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up carried to each purchase; before the first one, the first one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    whole = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = e.withColumn("_last", carry_forward(signup, key=["user_id"], order=["ts", "event_id"])).withColumn("_first", F.first(signup, ignorenulls=True).over(whole))
    return x.where("event_type = 'purchase'").select("event_id", "user_id", F.coalesce("_last", "_first").alias("signup"))


@query(
    "lookback_counts",
    """
SELECT event_id, count(*) OVER w AS n, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS errors, round(coalesce(sum(value) OVER w, 0), 4) AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING)""",
)
def lookback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the three days before, the moment itself excluded."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-3 * 86_400_000_000, -1)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("_us"))
    return e.select("event_id", F.count("*").over(w).alias("n"), F.coalesce(F.sum((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)).alias("errors"), F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 4).alias("total"))


@query("band_cohort", "SELECT p_partkey, round(avg(p_retailprice) OVER w, 4) AS cohort_mean, count(p_retailprice) OVER w AS cohort_n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def q_band_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = band_cohort(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), by=["p_brand"], on="p_size", width=3, value="p_retailprice")
    return x.select("p_partkey", F.round("cohort_mean", 4).alias("cohort_mean"), "cohort_n")


@query(
    "exact_multi_key",
    """
WITH a AS (SELECT season, preset, position, name, team, min(adp) AS adp FROM draftbench WHERE preset = 'ppr' GROUP BY ALL), b AS (SELECT season, preset, position, name, team, min(adp) AS adp FROM draftbench WHERE preset = 'standard' GROUP BY ALL),
x AS (SELECT a.season, a.position, a.name, a.team, round(a.adp, 1) AS adp, round(b.adp - a.adp, 1) AS twin_delta FROM a JOIN b USING (season, position, name, team))
SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM draftbench d WHERE d.preset = 'half_ppr' AND d.season = x.season AND d.name = x.name)""",
)
def exact_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two presets that agree in all keys, less the seasons and names that a third has."""
    d = table(spark, sf_dir, "draftbench")
    side = lambda p, c: d.where(F.col("preset") == p).groupBy("season", "position", "name", "team").agg(F.min("adp").alias(c))
    x = side("ppr", "adp").join(side("standard", "twin"), ["season", "position", "name", "team"])
    x = x.join(d.where("preset = 'half_ppr'").select("season", "name"), ["season", "name"], "left_anti")
    return x.select("season", "position", "name", "team", F.round("adp", 1).alias("adp"), F.round(F.col("twin") - F.col("adp"), 1).alias("twin_delta"))


@query(
    "anti_sum",
    """
WITH m AS (SELECT l_suppkey, l_partkey, date_trunc('month', l_shipdate) AS month, l_quantity FROM lineitem), f AS (SELECT l_suppkey, max(month) AS last FROM m GROUP BY 1),
k AS (SELECT DISTINCT m.l_suppkey, m.l_partkey FROM m JOIN f ON f.l_suppkey = m.l_suppkey AND m.month = f.last)
SELECT m.l_suppkey, round(sum(l_quantity), 2) AS vacated, count(*) AS n FROM m ANTI JOIN k ON k.l_suppkey = m.l_suppkey AND k.l_partkey = m.l_partkey GROUP BY 1""",
)
def anti_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of the parts that a supplier's last month no longer lists."""
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.date_trunc("month", "l_shipdate").alias("month"), "l_quantity")
    last = m.groupBy("l_suppkey").agg(F.max("month").alias("month"))
    kept = m.join(last, ["l_suppkey", "month"]).select("l_suppkey", "l_partkey").distinct()
    return m.join(kept, ["l_suppkey", "l_partkey"], "left_anti").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("vacated"), F.count("*").alias("n"))


_MONTHLY = "SELECT date_trunc('month', ts) AS month, user_id, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "user_id").agg(F.round(F.sum("value"), 2).alias("v"))


@query(
    "pair_candidates",
    f"""
WITH m AS ({_MONTHLY})
SELECT a.month, a.user_id AS a, b.user_id AS b FROM m a JOIN m b ON a.month = b.month AND a.v > 0 AND b.v > 0 AND (a.v < b.v OR (a.v = b.v AND a.user_id < b.user_id)) AND b.v - a.v <= 0.002 * b.v""",
)
def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a month whose totals differ by at most 0.2 %."""
    return tolerance_pairs(monthly(spark, sf_dir), by=["month"], id="user_id", value="v", tolerance=0.002).select("month", "a", "b")


@query("greedy_pairs")
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint pairs of the candidates, taken in a seeded hash order."""
    p = tolerance_pairs(monthly(spark, sf_dir), by=["month"], id="user_id", value="v", tolerance=0.002)
    p = p.withColumn("seed", F.sha2(F.concat_ws(":", F.lit("5"), F.col("a").cast("string"), F.col("b").cast("string")), 256))
    return greedy_disjoint(p, by=["month"], order=["seed", "a", "b"]).select("month", "a", "b")


@query(
    "universe_flags",
    f"""
WITH s AS (SELECT DISTINCT player_id AS id FROM season_points), d AS (SELECT DISTINCT nflverse_id AS id FROM draftbench WHERE nflverse_id IS NOT NULL), p AS (SELECT DISTINCT player_id AS id FROM {_PF} WHERE player_id IS NOT NULL), t AS (SELECT DISTINCT player_id AS id FROM documents WHERE player_id IS NOT NULL),
u AS (SELECT id, 1 AS s, 0 AS d, 0 AS p, 0 AS t FROM s UNION ALL SELECT id, 0, 1, 0, 0 FROM d UNION ALL SELECT id, 0, 0, 1, 0 FROM p UNION ALL SELECT id, 0, 0, 0, 1 FROM t)
SELECT id, max(s) = 1 AS in_points, max(d) = 1 AS in_board, max(p) = 1 AS in_packets, max(t) = 1 AS in_documents FROM u GROUP BY 1""",
)
def universe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player of any source, with the sources that have it."""
    ids = {
        "in_points": table(spark, sf_dir, "season_points").select(F.col("player_id").alias("id")),
        "in_board": table(spark, sf_dir, "draftbench").select(F.col("nflverse_id").alias("id")),
        "in_packets": table(spark, sf_dir, "packet_features").select(F.col("player_id").alias("id")),
        "in_documents": table(spark, sf_dir, "documents").select(F.col("player_id").alias("id")),
    }
    rows = [df.where(F.col("id").isNotNull()).distinct().select("id", *[F.lit(c == name).alias(c) for c in ids]) for name, df in ids.items()]
    u = rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
    return u.groupBy("id").agg(*[F.bool_or(c).alias(c) for c in ids])


@query(
    "paired_arms",
    """
WITH a AS (SELECT user_id // 2 AS episode, date_trunc('day', ts) AS day, round(sum(value), 4) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id // 2 AS episode, date_trunc('day', ts) AS day, round(sum(value), 4) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.episode, b.episode) AS episode, coalesce(a.day, b.day) AS day, round(b.v - a.v, 4) AS delta, CASE WHEN a.v IS NULL THEN 'control missing' WHEN b.v IS NULL THEN 'treated missing' ELSE 'paired' END AS state FROM a FULL JOIN b ON a.episode = b.episode AND a.day = b.day""",
)
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms of an episode side by side; unpaired ones are named, not dropped."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 2).alias("episode"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("user_id") % 2, "value").toDF("episode", "day", "arm", "value")
    x = e.groupBy("episode", "day").agg(F.round(F.sum(F.when(F.col("arm") == 0, F.col("value"))), 4).alias("a"), F.round(F.sum(F.when(F.col("arm") == 1, F.col("value"))), 4).alias("b"))
    state = F.when(F.col("a").isNull(), "control missing").when(F.col("b").isNull(), "treated missing").otherwise("paired")
    return x.select("episode", "day", F.round(F.col("b") - F.col("a"), 4).alias("delta"), state.alias("state"))


@query(
    "grid_panel",
    """
WITH p AS (SELECT DISTINCT preset FROM draftbench), s AS (SELECT DISTINCT season FROM season_points), g AS (SELECT season, preset FROM s CROSS JOIN p),
h AS (SELECT DISTINCT season, preset FROM draftbench), k AS (SELECT g.* FROM g SEMI JOIN h ON h.season = g.season AND h.preset = g.preset)
SELECT k.season, k.preset, seed, slot, row_number() OVER (PARTITION BY k.season ORDER BY sha256(k.season || ':' || k.preset || ':' || seed || ':' || slot)) <= 4 AS in_panel FROM k, range(3) a(seed), range(1, 13) b(slot)""",
)
def grid_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of seasons, presets with a board, seeds and slots, with four panel cells per season."""
    cells = table(spark, sf_dir, "draftbench").select("season", "preset").distinct().join(table(spark, sf_dir, "season_points").select("season").distinct(), "season", "left_semi")
    g = cells.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(12))))
    key = F.sha2(F.concat_ws(":", F.col("season").cast("string"), "preset", F.col("seed").cast("string"), F.col("slot").cast("string")), 256)
    return g.select("season", "preset", F.col("seed").cast("long").alias("seed"), F.col("slot").cast("long").alias("slot"), (F.row_number().over(Window.partitionBy("season").orderBy(key)) <= 4).alias("in_panel"))


@query(
    "key_union_ledger",
    """
WITH o AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1, 2), s AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1, 2)
SELECT coalesce(o.year, s.year) AS year, coalesce(o.month, s.month) AS month, ordered, shipped, round(coalesce(ordered, 0) - coalesce(shipped, 0), 2) AS remainder, coalesce(ordered, 0) >= coalesce(shipped, 0) AS balanced FROM o FULL JOIN s ON o.year = s.year AND o.month = s.month""",
)
def key_union_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers over the union of their months, and whether the remainder is negative."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    rest = F.coalesce("ordered", F.lit(0.0)) - F.coalesce("shipped", F.lit(0.0))
    return o.join(s, ["year", "month"], "full").select("year", "month", "ordered", "shipped", F.round(rest, 2).alias("remainder"), (rest >= 0).alias("balanced"))


@query(
    "cascade_resolve",
    f"""
WITH p AS (SELECT DISTINCT player_id FROM season_points), w AS (SELECT DISTINCT gsis_id FROM depth_weekly), s AS (SELECT DISTINCT gsis_id FROM depth_snapshot)
SELECT packet_id, coalesce(p.player_id, w.gsis_id, s.gsis_id) AS resolved, CASE WHEN p.player_id IS NOT NULL THEN 'points' WHEN w.gsis_id IS NOT NULL THEN 'weekly' WHEN s.gsis_id IS NOT NULL THEN 'snapshot' ELSE 'none' END AS source
FROM {_PF} f LEFT JOIN p ON p.player_id = f.player_id LEFT JOIN w ON w.gsis_id = f.player_id LEFT JOIN s ON s.gsis_id = f.player_id""",
)
def cascade_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id looked up in three sources, the first that has it wins."""
    f = latest_packets(spark, sf_dir).select("packet_id", "player_id")
    names = (("points", "season_points", "player_id"), ("weekly", "depth_weekly", "gsis_id"), ("snapshot", "depth_snapshot", "gsis_id"))
    for name, t, key in names:
        f = f.join(table(spark, sf_dir, t).select(F.col(key).alias("player_id"), F.lit(name).alias(f"_{name}")).distinct(), "player_id", "left")
    source = F.coalesce(*[F.col(f"_{n}") for n, _, _ in names])
    return f.select("packet_id", F.when(source.isNotNull(), F.col("player_id")).alias("resolved"), F.coalesce(source, F.lit("none")).alias("source"))


@query(
    "asof_contract",
    """
WITH c AS (SELECT o_custkey, year(o_orderdate) AS year_signed, o_totalprice AS value, 1 + o_orderkey % 4 AS years, o_orderkey FROM orders),
t AS (SELECT DISTINCT o_custkey, s AS season FROM c, range(1993, 2000) r(s)),
j AS (SELECT t.o_custkey, t.season, c.year_signed, c.value, c.years, c.o_orderkey FROM t JOIN c ON c.o_custkey = t.o_custkey AND c.year_signed <= t.season QUALIFY row_number() OVER (PARTITION BY t.o_custkey, t.season ORDER BY year_signed DESC, value DESC, years DESC, o_orderkey DESC) = 1)
SELECT o_custkey, season, o_orderkey, year_signed + years - 1 AS end_year, season = year_signed + years - 1 AS contract_year FROM j WHERE year_signed + years - 1 >= season""",
)
def asof_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract that covers a season: the latest signed by then, if it still runs."""
    c = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year_signed"), F.col("o_totalprice").alias("value"), (1 + F.col("o_orderkey") % 4).alias("years"), "o_orderkey")
    # Of the contracts of one year only the best can be in force: one struct a year, carried over the seasons.
    best = c.groupBy("o_custkey", "year_signed").agg(F.max(F.struct("year_signed", "value", "years", "o_orderkey")).alias("c"))
    first = best.groupBy("o_custkey").agg(F.min("year_signed").alias("first"))
    seasons = first.select("o_custkey", F.explode(F.sequence(F.least("first", F.lit(1993)), F.lit(1999))).alias("season"))
    x = seasons.join(best.withColumnRenamed("year_signed", "season"), ["o_custkey", "season"], "left")
    x = x.withColumn("c", F.max("c").over(Window.partitionBy("o_custkey").orderBy("season").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("season").between(1993, 1999))
    end = F.col("c.year_signed") + F.col("c.years") - 1
    return x.where(end >= F.col("season")).select("o_custkey", "season", F.col("c.o_orderkey").alias("o_orderkey"), end.alias("end_year"), (F.col("season") == end).alias("contract_year"))


@query(
    "typed_scan_lookup",
    """
SELECT c_custkey, n_name AS nation, r_name AS region, CASE WHEN r_name = 'EUROPE' THEN 'EU' ELSE left(r_name, 2) END AS code, coalesce(c_acctbal > 0, false) AS in_credit FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def typed_scan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered scan with code lookups; nation and region have a fixed size, so they are broadcast."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    x = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    code = F.when(F.col("r_name") == "EUROPE", "EU").otherwise(F.left("r_name", F.lit(2)))
    return x.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), code.alias("code"), F.coalesce(F.col("c_acctbal") > 0, F.lit(False)).alias("in_credit"))


@query(
    "nested_history",
    """
SELECT l_orderkey, len(list_filter(list(struct_pack(n := l_linenumber, q := l_quantity, f := l_returnflag) ORDER BY l_linenumber), lambda x: x.f = 'R')) AS returned,
  CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS only_flag, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first_returned,
  arg_max(l_partkey, (l_linenumber, l_quantity, l_returnflag, l_partkey)) AS last_part, bool_or(l_quantity > 45) AS has_large FROM lineitem GROUP BY 1""",
)
def nested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, unique matches and first or last elements inside an array of structs."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_partkey"))).alias("h"))
    back = F.filter("h", lambda x: x["l_returnflag"] == "R")
    flags = F.array_distinct(F.transform("h", lambda x: x["l_returnflag"]))
    return h.select(
        "l_orderkey", F.size(back).cast("long").alias("returned"), F.when(F.size(flags) == 1, F.element_at(flags, 1)).alias("only_flag"), F.array_min(F.transform(back, lambda x: x["l_linenumber"])).alias("first_returned"),
        F.element_at("h", -1)["l_partkey"].alias("last_part"), F.exists("h", lambda x: x["l_quantity"] > 45).alias("has_large"),
    )


_WIDE = (
    f"""
WITH u AS (SELECT DISTINCT season, player_id FROM {_PF} WHERE season IS NOT NULL AND player_id IS NOT NULL), s AS (SELECT season, player_id, max(total_ppr) AS ppr, max(games) AS games, max(position) AS position FROM season_points GROUP BY 1, 2),
d AS (SELECT season, gsis_id AS player_id, arg_max(struct_pack(v := try_cast(depth_team AS INTEGER)), (week, loaded_at, depth_id)).v AS depth FROM depth_weekly GROUP BY 1, 2),
n AS (SELECT player_id, year(make_timestamp(published_ms * 1000)) AS season, count(DISTINCT doc_id) AS news FROM documents WHERE player_id IS NOT NULL AND published_ms IS NOT NULL GROUP BY 1, 2)
SELECT u.season, u.player_id, round(a.ppr, 2) AS ppr_s1, round(a.ppr / nullif(a.games, 0), 4) AS ppg_s1, round(a.ppr - b.ppr, 2) AS change, d.depth, coalesce(n.news, 0) AS news,
  CASE WHEN a.player_id IS NULL THEN 'missing' ELSE 'ok' END AS usage_status, CASE WHEN d.player_id IS NULL THEN 'missing' WHEN d.depth IS NULL THEN 'unparsed' ELSE 'ok' END AS depth_status, CASE WHEN n.news IS NULL THEN 'none' ELSE 'ok' END AS news_status
FROM u LEFT JOIN s a ON a.player_id = u.player_id AND a.season = u.season - 1 LEFT JOIN s b ON b.player_id = u.player_id AND b.season = u.season - 2
LEFT JOIN d ON d.player_id = u.player_id AND d.season = u.season - 1 LEFT JOIN n ON n.player_id = u.player_id AND n.season = u.season"""
)


@query("wide_packet", _WIDE)
def wide_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row per player and season: earlier seasons, depth, news, each with a status of its own."""
    u = latest_packets(spark, sf_dir).where(F.col("season").isNotNull() & F.col("player_id").isNotNull()).select("season", "player_id").distinct()
    s = table(spark, sf_dir, "season_points").groupBy("season", "player_id").agg(F.max("total_ppr").alias("ppr"), F.max("games").alias("games"))
    back = lambda k, *c: s.select((F.col("season") + k).alias("season"), "player_id", *c)
    a = back(1, F.col("ppr").alias("a_ppr"), F.col("games").alias("a_games"), F.lit(True).alias("a"))
    b = back(2, F.col("ppr").alias("b_ppr"))
    d = table(spark, sf_dir, "depth_weekly").groupBy("season", F.col("gsis_id").alias("player_id")).agg(
        F.max_by(F.struct(F.col("depth_team").try_cast("int").alias("v")), F.struct("week", "loaded_at", "depth_id"))["v"].alias("depth"), F.lit(True).alias("d")
    )
    d = d.select((F.col("season") + 1).alias("season"), "player_id", "depth", "d")
    n = table(spark, sf_dir, "documents").where(F.col("player_id").isNotNull() & F.col("published_ms").isNotNull())
    n = n.groupBy("player_id", F.year(F.timestamp_millis("published_ms")).alias("season")).agg(F.count_distinct("doc_id").alias("news"))
    x = u.join(a, ["season", "player_id"], "left").join(b, ["season", "player_id"], "left").join(d, ["season", "player_id"], "left").join(n, ["season", "player_id"], "left")
    return x.select(
        "season", "player_id", F.round("a_ppr", 2).alias("ppr_s1"), F.round(F.try_divide("a_ppr", "a_games"), 4).alias("ppg_s1"), F.round(F.col("a_ppr") - F.col("b_ppr"), 2).alias("change"), "depth", F.coalesce("news", F.lit(0)).alias("news"),
        F.when(F.col("a").isNull(), "missing").otherwise("ok").alias("usage_status"), F.when(F.col("d").isNull(), "missing").when(F.col("depth").isNull(), "unparsed").otherwise("ok").alias("depth_status"), F.when(F.col("news").isNull(), "none").otherwise("ok").alias("news_status"),
    )


@query(
    "slate_scores",
    _YEARLY
    + """, k AS (SELECT y.year, y.custkey, y.rank <= 24 AS hit, a.rank AS market FROM y JOIN y a ON a.custkey = y.custkey AND a.year = y.year - 1),
q AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY market, custkey) AS pick FROM k)
SELECT year, sum(CASE WHEN pick <= 10 AND hit THEN 1 ELSE 0 END)::BIGINT AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS base_rate,
  round(sum(CASE WHEN pick <= 10 AND hit THEN 1 ELSE 0 END) / nullif(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * least(10, count(*)), 0), 6) AS lift FROM q GROUP BY 1""",
)
def slate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among the ten picks of a slate, its base rate and the lift."""
    y = yearly(spark, sf_dir)
    before = y.select((F.col("year") + 1).alias("year"), "custkey", F.col("rank").alias("market"))
    k = y.join(before, ["year", "custkey"]).select("year", "custkey", (F.col("rank") <= 24).alias("hit"), F.row_number().over(Window.partitionBy("year").orderBy("market", "custkey")).alias("pick"))
    hits, rate = F.sum((F.col("hit") & (F.col("pick") <= 10)).cast("int")), F.avg(F.col("hit").cast("double"))
    return k.groupBy("year").agg(hits.alias("hits"), F.round(rate, 6).alias("base_rate"), F.round(F.try_divide(hits, rate * F.least(F.lit(10), F.count("*"))), 6).alias("lift"))


@query(
    "text_pairs",
    """
WITH n AS (SELECT DISTINCT player_id, lower(player) AS name FROM season_points), k AS (SELECT DISTINCT player_id, name, left(name, 3) AS block FROM n)
SELECT a.player_id AS a, b.player_id AS b, a.name AS name_a, b.name AS name_b, levenshtein(a.name, b.name) AS distance FROM k a JOIN k b ON a.block = b.block AND a.player_id < b.player_id
WHERE abs(length(a.name) - length(b.name)) <= 0.1 * greatest(length(a.name), length(b.name)) AND levenshtein(a.name, b.name) <= 0.1 * greatest(length(a.name), length(b.name))""",
)
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one block whose edit similarity is at least 0.9; the length bound is checked first."""
    k = table(spark, sf_dir, "season_points").select("player_id", F.lower("player").alias("name")).distinct().withColumn("block", F.left("name", F.lit(3)))
    a, b = k.toDF("a", "name_a", "block"), k.toDF("b", "name_b", "block")
    most = 0.1 * F.greatest(F.length("name_a"), F.length("name_b"))
    x = a.join(b, "block").where((F.col("a") < F.col("b")) & (F.abs(F.length("name_a") - F.length("name_b")) <= most))
    return x.withColumn("distance", F.levenshtein("name_a", "name_b")).where(F.col("distance") <= most).select("a", "b", "name_a", "name_b", F.col("distance").cast("long").alias("distance"))


@query(
    "text_pairs_all",
    """
WITH n AS (SELECT DISTINCT player_id, lower(player) AS name FROM season_points)
SELECT a.player_id AS a, b.player_id AS b, a.name AS name_a, b.name AS name_b, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.player_id < b.player_id
WHERE abs(length(a.name) - length(b.name)) <= 0.1 * greatest(length(a.name), length(b.name)) AND levenshtein(a.name, b.name) <= 0.1 * greatest(length(a.name), length(b.name))""",
)
def text_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_pairs`` without blocks: names whose edit similarity is at least 0.9, wherever they differ."""
    k = table(spark, sf_dir, "season_points").select("player_id", F.lower("player").alias("name")).dropna().distinct()
    x = edit_pairs(k.withColumn("id", F.concat("player_id", F.lit("\n"), "name")), by=[], id="id", text="name")
    player = lambda c: F.substring_index(c, "\n", 1)
    ends = F.array_sort(F.array(*[F.struct(player(c).alias("id"), F.col(f"text_{c}").alias("name")) for c in "ab"]))
    x = x.where(player("a") != player("b")).select(ends.alias("e"), "distance")
    return x.select(*[F.col("e")[i][f].alias(n) for f, names in (("id", "ab"), ("name", ("name_a", "name_b"))) for i, n in enumerate(names)], "distance")


@query("response_pairs")
def response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct replies of one subtype (else family) whose edit similarity is at least 0.9; a and b are their lowest rows."""
    reply = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    t = table(spark, sf_dir, "t11_targeted_v1").select(F.coalesce("t11_subtype", "family", F.lit("")).alias("subtype"), "row_id", tx.plain(reply).alias("text"))
    return edit_pairs(t.where(F.col("text").isNotNull()).groupBy("subtype", "text").agg(F.min("row_id").alias("row_id")), by=["subtype"], id="row_id", text="text")
