"""Scores, totals, ranks, labels and case expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.functions.scalar import half_even_sql, half_up
from pointgate.operators import scoring as sc
from pointgate.operators.ranking import sliced_rank, unique_rank
from pointgate.operators.temporal import prior_period
from pointgate.plans.registry import query
from pointgate.session import table

#: Weights of the line items' score; returned lines count their price less.
LINE_SCORING = sc.Scoring({"quantity": 0.5, "price": 0.001, "discount": -2.0, "tax": -1.0}, {"R": {"price": 0.0004}})


@query(
    "score_weighted",
    "WITH x AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0)::DOUBLE * 0.5::DOUBLE AS a, coalesce(l_extendedprice, 0)::DOUBLE * CASE WHEN l_returnflag = 'R' THEN 0.0004::DOUBLE ELSE 0.001::DOUBLE END AS b, coalesce(l_discount, 0)::DOUBLE * -2.0::DOUBLE AS c, coalesce(l_tax, 0)::DOUBLE * -1.0::DOUBLE AS d FROM lineitem), "
    f"y AS (SELECT l_orderkey, l_linenumber, {half_even_sql('a', 4)} + {half_even_sql('b', 4)} + {half_even_sql('c', 4)} + {half_even_sql('d', 4)} AS t FROM x) SELECT l_orderkey, l_linenumber, {half_even_sql('t', 2)} AS score FROM y",
)
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = {"quantity": sc.number(F.col("l_quantity")), "price": sc.number(F.col("l_extendedprice")), "discount": sc.number(F.col("l_discount")), "tax": sc.number(F.col("l_tax"))}
    return sc.weighted_score(table(spark, sf_dir, "lineitem"), LINE_SCORING, stats, F.col("l_returnflag")).select("l_orderkey", "l_linenumber", "score")


@query("config_fingerprint", "SELECT substr(sha256('{\"overrides\": {\"R\": {\"price\": 0.0004}}, \"weights\": {\"discount\": -2.0, \"price\": 0.001, \"quantity\": 0.5, \"tax\": -1.0}}'), 1, 12) AS fingerprint, 4 AS stats")
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(LINE_SCORING.fingerprint()).alias("fingerprint"), F.lit(len(LINE_SCORING.weights)).alias("stats"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, segment, custkey, total, orders, rank): customers of a segment ranked by their year's total."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    t = o.groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    r = t.join(c, "o_custkey")
    return r.select("year", "segment", F.col("o_custkey").alias("custkey"), "total", "orders", unique_rank(["year", "segment"], [F.col("total").desc(), "o_custkey"]).alias("rank"))


_YEARLY = """
WITH t AS (SELECT o_custkey AS custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders GROUP BY 1, 2),
y AS (SELECT year, c_mktsegment AS segment, custkey, total, orders, row_number() OVER (PARTITION BY year, c_mktsegment ORDER BY total DESC, custkey) AS rank FROM t JOIN customer ON c_custkey = custkey)
"""


@query("period_totals_rank", _YEARLY + "SELECT * FROM y")
def period_totals_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearly(spark, sf_dir)


@query(
    "season_totals",
    """
SELECT customer.c_nationkey AS nation, o_custkey AS custkey, count(*) AS games, round(sum(o_totalprice), 2) AS total, string_agg(DISTINCT o_orderstatus, '/' ORDER BY o_orderstatus) AS teams,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_name
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
)
def season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, the set of states joined by '/', and the last priority by date."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("games"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "/").alias("teams"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_name"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return o.join(c, "o_custkey").select("nation", F.col("o_custkey").alias("custkey"), "games", "total", "teams", "last_name")


@query("board_rank", "SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_size DESC, p_name, p_partkey) AS pos_rank, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) AS shared_rank FROM part")
def board_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.rank().over(Window.partitionBy("p_type").orderBy("p_retailprice"))
    order = ["p_retailprice", F.col("p_size").desc(), "p_name", "p_partkey"]
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", unique_rank(["p_type"], order).alias("pos_rank"), shared.alias("shared_rank"))


@query(
    "prior_period_block",
    _YEARLY
    + """SELECT y.year, y.custkey, y.total, a.total AS prior1_total, a.rank AS prior1_rank, b.total AS prior2_total, b.rank AS prior2_rank,
  round(y.total - a.total, 2) AS delta, coalesce(a.segment IS NULL, true) AS is_new
FROM y LEFT JOIN y a ON a.custkey = y.custkey AND a.year = y.year - 1 LEFT JOIN y b ON b.custkey = y.custkey AND b.year = y.year - 2""",
)
def prior_period_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yearly(spark, sf_dir).select("year", "custkey", "total", "rank")
    x = prior_period(y, key=["custkey"], period="year", values=["total", "rank"])
    two = prior_period(y, key=["custkey"], period="year", values=["total", "rank"], steps=2).select("year", "custkey", "prior2_total", "prior2_rank")
    return x.join(two, ["custkey", "year"]).select(
        "year", "custkey", "total", "prior1_total", "prior1_rank", "prior2_total", "prior2_rank", F.round(F.col("total") - F.col("prior1_total"), 2).alias("delta"), F.col("prior1_total").isNull().alias("is_new")
    )


@query(
    "gate_labels",
    _YEARLY
    + """, l AS (SELECT y.year, y.segment, y.custkey, y.rank AS finish, a.rank AS market,
  CASE WHEN a.rank IS NULL THEN 'undrafted' WHEN a.rank > 40 AND y.rank <= 24 THEN 'breakout' WHEN a.rank <= 12 AND y.rank > 24 THEN CASE WHEN y.orders < 2 THEN 'injury_bust' ELSE 'bust' END ELSE 'neither' END AS label,
  CASE WHEN a.rank - 24 <= 12 THEN 'near_gate' WHEN a.rank - 24 <= 30 THEN 'mid' ELSE 'deep' END AS band
FROM y LEFT JOIN y a ON a.custkey = y.custkey AND a.year = y.year - 1),
r AS (SELECT year, sum(CASE WHEN label = 'breakout' THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM l GROUP BY 1)
SELECT l.*, round((SELECT sum(hits) / sum(n) FROM r WHERE r.year < l.year), 6) AS base_rate FROM l""",
)
def gate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the rank before and after, with the base rate of strictly earlier years."""
    y = yearly(spark, sf_dir)
    x = prior_period(y.select("year", "segment", "custkey", "orders", "rank"), key=["custkey"], period="year", values=["rank"])
    bust = (F.col("prior1_rank") <= 12) & (F.col("rank") > 24)
    label = F.when(F.col("prior1_rank").isNull(), "undrafted").when((F.col("prior1_rank") > 40) & (F.col("rank") <= 24), "breakout").when(bust & (F.col("orders") < 2), "injury_bust").when(bust, "bust").otherwise("neither")
    l = x.select("year", "segment", "custkey", F.col("rank").alias("finish"), F.col("prior1_rank").alias("market"), label.alias("label"), sc.band(F.col("prior1_rank") - 24).alias("band"))
    r = l.groupBy("year").agg(F.sum((F.col("label") == "breakout").cast("int")).alias("hits"), F.count("*").alias("n"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    rates = r.select("year", F.round(F.try_divide(F.sum("hits").over(before), F.sum("n").over(before)), 6).alias("base_rate"))
    return l.join(F.broadcast(rates), "year").select("year", "segment", "custkey", "finish", "market", "label", "band", "base_rate")


@query(
    "undrafted_anti",
    _YEARLY + "SELECT y.year, y.segment, y.custkey, y.rank AS finish, (SELECT max(rank) + 1 FROM y d WHERE d.year = y.year AND d.segment = y.segment) AS market, true AS breakout FROM y WHERE rank <= 24 AND NOT EXISTS (SELECT 1 FROM y a WHERE a.custkey = y.custkey AND a.year = y.year - 1)",
)
def undrafted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top finishers that the year before lacks, as rows one past the depth of their pool."""
    y = yearly(spark, sf_dir)
    depth = y.groupBy("year", "segment").agg((F.max("rank") + 1).alias("market"))
    known = y.select((F.col("year") + 1).alias("year"), "custkey")
    new = y.where(F.col("rank") <= 24).join(known, ["year", "custkey"], "left_anti").join(depth, ["year", "segment"])
    return new.select("year", "segment", "custkey", F.col("rank").alias("finish"), "market", F.lit(True).alias("breakout"))


_PLAYER = "SELECT DISTINCT season, player_id, position, games, total_ppr, pos_season_rank_ppr AS finish FROM season_points"


@query(
    "family_outcomes",
    f"""
WITH s AS ({_PLAYER}), m AS (SELECT a.season, a.player_id, a.position, a.finish, b.finish AS market FROM s a LEFT JOIN s b ON b.player_id = a.player_id AND b.season = a.season - 1),
f AS (SELECT *, unnest(list_filter([CASE WHEN market <= 12 THEN 'bust' END, CASE WHEN market > 12 THEN 'breakout' END, CASE WHEN market IS NOT NULL THEN 'full_slate' END], lambda x: x IS NOT NULL)) AS family FROM m)
SELECT season, player_id, family, CASE family WHEN 'bust' THEN finish > 24 WHEN 'breakout' THEN finish <= 12 ELSE finish <= 24 END AS outcome FROM f""",
)
def family_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three families for a row, and the outcome that each asks for."""
    s = table(spark, sf_dir, "season_points").select("season", "player_id", "position", "games", "total_ppr", F.col("pos_season_rank_ppr").alias("finish")).distinct()
    before = s.select((F.col("season") + 1).alias("season"), "player_id", F.col("finish").alias("market"))
    m = s.join(before, ["season", "player_id"], "left")
    families = F.array_compact(F.array(F.when(F.col("market") <= 12, "bust"), F.when(F.col("market") > 12, "breakout"), F.when(F.col("market").isNotNull(), "full_slate")))
    f = m.withColumn("family", F.explode(families))
    outcome = F.when(F.col("family") == "bust", F.col("finish") > 24).when(F.col("family") == "breakout", F.col("finish") <= 12).otherwise(F.col("finish") <= 24)
    return f.select("season", "player_id", "family", outcome.alias("outcome"))


@query(
    "case_battery",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS p, l_discount, l_extendedprice AS price, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, round(least(greatest(p + least(greatest(l_discount - p, -0.15), 0.15) / 3, 0.08), 0.85), 6) AS shrunk,
  l_discount BETWEEN greatest(p, 0.02) / 3 AND least(0.95, 5 * p) AS plausible, CASE WHEN p < 0.2 THEN 'unlikely' WHEN p < 0.5 THEN 'possible' WHEN p < 0.8 THEN 'likely' ELSE 'very likely' END AS said,
  CASE WHEN price < 10000 THEN 'before_first' WHEN price >= 50000 THEN 'after_last' WHEN price < 30000 THEN CASE WHEN price - 10000 <= 30000 - price THEN 'reach_back' ELSE 'wait' END ELSE CASE WHEN price - 30000 <= 50000 - price THEN 'reach_back' ELSE 'wait' END END AS "window",
  CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 'before' ELSE 'sealed' END AS gate, 'Q' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS label,
  CASE WHEN greatest(l_discount, p) <> 0 THEN round((l_discount - p) / greatest(l_discount, p), 6) END AS edge
FROM x""",
)
def case_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("p"), "l_discount", F.col("l_extendedprice").alias("price"), "l_shipdate")
    p, d = F.col("p"), F.col("l_discount")
    return x.select(
        "l_orderkey", "l_linenumber", F.least(F.floor(p * 10), F.lit(9)).cast("int").alias("bin"), F.round(sc.shrink(p, d), 6).alias("shrunk"),
        d.between(F.greatest(p, F.lit(0.02)) / 3, F.least(F.lit(0.95), 5 * p)).alias("plausible"),
        F.when(p < 0.2, "unlikely").when(p < 0.5, "possible").when(p < 0.8, "likely").otherwise("very likely").alias("said"),
        sc.price_window(F.col("price"), F.array(F.lit(10000.0), F.lit(30000.0), F.lit(50000.0)))["window"].alias("window"),
        F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz"), "before").otherwise("sealed").alias("gate"),
        F.concat(F.lit("Q"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("label"), F.round(sc.relative_edge(d, p), 6).alias("edge"),
    )


_GAMES = "SELECT DISTINCT game_id, season, week, home_team, away_team, home_score, away_score, spread_line, total_line FROM games WHERE game_type = 'REG' AND spread_line IS NOT NULL AND NOT isnan(spread_line) AND total_line IS NOT NULL AND NOT isnan(total_line)"


def lined_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "games").where((F.col("game_type") == "REG") & F.nanvl("spread_line", F.lit(None)).isNotNull() & F.nanvl("total_line", F.lit(None)).isNotNull())
    return g.select("game_id", "season", "week", "home_team", "away_team", "home_score", "away_score", "spread_line", "total_line").distinct()


def two_sided(games: DataFrame) -> DataFrame:
    """One game as two team rows: implied points and the line from the team's own side."""
    home = F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home"), (F.col("total_line") / 2 + F.col("spread_line") / 2).alias("implied"), (-F.col("spread_line")).alias("line"), F.col("home_score").alias("scored"))
    away = F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home"), (F.col("total_line") / 2 - F.col("spread_line") / 2).alias("implied"), F.col("spread_line").alias("line"), F.col("away_score").alias("scored"))
    return games.select("game_id", "season", "week", F.explode(F.array(home, away)).alias("x")).select("game_id", "season", "week", "x.*")


_TWO = f"""
WITH g AS ({_GAMES}), t AS (
  SELECT game_id, season, week, home_team AS team, away_team AS opponent, true AS is_home, total_line / 2 + spread_line / 2 AS implied, -spread_line AS line, home_score AS scored FROM g
  UNION ALL SELECT game_id, season, week, away_team, home_team, false, total_line / 2 - spread_line / 2, spread_line, away_score FROM g)
"""


@query("unpivot_two_sided", _TWO + "SELECT * FROM t")
def unpivot_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_sided(lined_games(spark, sf_dir))


@query(
    "implied_totals",
    _TWO
    + """, a AS (SELECT season, team, count(*) AS n, round(avg(implied), 4) AS mean_implied, round(arg_min(implied, week), 4) AS week1_implied, CAST(sum(scored) AS BIGINT) AS points FROM t GROUP BY 1, 2)
SELECT a.*, b.mean_implied AS prior_implied, round(a.mean_implied - b.mean_implied, 4) AS change FROM a LEFT JOIN a b ON b.team = a.team AND b.season = a.season - 1""",
)
def implied_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season means of implied points, the first week's, and the change to the season before."""
    t = two_sided(lined_games(spark, sf_dir))
    a = t.groupBy("season", "team").agg(F.count("*").alias("n"), F.round(F.avg("implied"), 4).alias("mean_implied"), F.round(F.min_by("implied", "week"), 4).alias("week1_implied"), F.sum("scored").alias("points"))
    x = prior_period(a, key=["team"], period="season", values=["mean_implied"])
    return x.select("season", "team", "n", "mean_implied", "week1_implied", "points", F.col("prior1_mean_implied").alias("prior_implied"), F.round(F.col("mean_implied") - F.col("prior1_mean_implied"), 4).alias("change"))


@query(
    "odds_devig",
    f"""
WITH g AS ({_GAMES}), o AS (SELECT game_id, CAST(round(-110 - spread_line * 10) AS INTEGER) AS a0, CAST(round(-110 + spread_line * 10) AS INTEGER) AS b0 FROM g),
q AS (SELECT game_id, CASE WHEN a0 = 0 THEN 100 ELSE a0 END AS a, CASE WHEN b0 = 0 THEN 100 ELSE b0 END AS b FROM o),
p AS (SELECT game_id, CASE WHEN a > 0 THEN 100.0::DOUBLE / (a + 100.0::DOUBLE) ELSE -a / (-a + 100.0::DOUBLE) END AS pa, CASE WHEN b > 0 THEN 100.0::DOUBLE / (b + 100.0::DOUBLE) ELSE -b / (-b + 100.0::DOUBLE) END AS pb FROM q)
SELECT game_id, round(pa / (pa + pb), 6) AS home, round(pb / (pa + pb), 6) AS away, round(pa + pb - 1, 6) AS margin FROM p""",
)
def odds_devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lined_games(spark, sf_dir)
    safe = lambda c: F.when(c == 0, 100).otherwise(c)
    q = g.select("game_id", safe(F.round(-110 - F.col("spread_line") * 10).cast("int")).alias("a"), safe(F.round(-110 + F.col("spread_line") * 10).cast("int")).alias("b"))
    p = q.select("game_id", sc.american_odds(F.col("a")).alias("pa"), sc.american_odds(F.col("b")).alias("pb"))
    both = F.col("pa") + F.col("pb")
    return p.select("game_id", F.round(F.col("pa") / both, 6).alias("home"), F.round(F.col("pb") / both, 6).alias("away"), F.round(both - 1, 6).alias("margin"))


@query(
    "anonymise_mask",
    """
WITH r AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) AS n FROM customer)
SELECT c_mktsegment || '-Q' || lpad(CAST(n AS VARCHAR), 6, '0') AS question_id, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked, c_custkey AS key, substr(sha256(c_name), 1, 12) AS owner,
  CASE WHEN c_acctbal > 5000 THEN 'yes' WHEN c_acctbal < 0 THEN 'no' ELSE 'unresolved' END AS verdict FROM r""",
)
def anonymise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in seeded hash order within a segment, names without digits, and the sequestered key."""
    c = table(spark, sf_dir, "customer").withColumn("_h", F.sha2(F.concat(F.lit("7:"), F.col("c_custkey")), 256))
    c = c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "_h", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long").alias("_u"))
    c = sliced_rank(c, by=["c_mktsegment"], value="_u", tie=["_h", "c_custkey"], name="_n", descending=False)
    verdict = F.when(F.col("c_acctbal") > 5000, "yes").when(F.col("c_acctbal") < 0, "no").otherwise("unresolved")
    return c.select(
        F.concat("c_mktsegment", F.lit("-Q"), F.lpad(F.col("_n").cast("string"), 6, "0")).alias("question_id"), F.regexp_replace("c_name", "[0-9]+", "#").alias("masked"), F.col("c_custkey").alias("key"),
        F.substring(F.sha2("c_name", 256), 1, 12).alias("owner"), verdict.alias("verdict"),
    )


_PF = "(SELECT DISTINCT ON (packet_id) * FROM packet_features ORDER BY packet_id, ingested_at DESC NULLS LAST)"


@query(
    "feature_encode",
    f"""
SELECT packet_id, CAST(position = 'QB' AS INTEGER) AS is_qb, CAST(position = 'RB' AS INTEGER) AS is_rb, CAST(position = 'WR' AS INTEGER) AS is_wr, CAST(position = 'TE' AS INTEGER) AS is_te,
  coalesce(games_s1, -1) AS games, CAST(games_s1 IS NULL AS INTEGER) AS games_missing, coalesce(pos_rank_asof, -1) AS depth, CAST(pos_rank_asof IS NULL AS INTEGER) AS depth_missing,
  CASE WHEN pos_rank_asof IS NULL THEN coalesce(depth_status, 'missing') ELSE 'ok' END AS status,
  list_sort(list_filter([CASE WHEN rookie_flag THEN 'rookie' END, CASE WHEN changed_team THEN 'moved' END, CASE WHEN undrafted THEN 'undrafted' END], lambda x: x IS NOT NULL)) AS tags
FROM {_PF}""",
)
def feature_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot positions, a sentinel and a flag for missing values, a status, and tags."""
    one = latest_packets(spark, sf_dir)
    hot = [(F.col("position") == p).cast("int").alias(f"is_{p.lower()}") for p in ("QB", "RB", "WR", "TE")]
    tags = F.array_sort(F.array_compact(F.array(F.when(F.col("rookie_flag"), "rookie"), F.when(F.col("changed_team"), "moved"), F.when(F.col("undrafted"), "undrafted"))))
    return one.select(
        "packet_id", *hot, F.coalesce("games_s1", F.lit(-1)).alias("games"), F.col("games_s1").isNull().cast("int").alias("games_missing"), F.coalesce("pos_rank_asof", F.lit(-1)).alias("depth"),
        F.col("pos_rank_asof").isNull().cast("int").alias("depth_missing"), F.when(F.col("pos_rank_asof").isNull(), F.coalesce("depth_status", F.lit("missing"))).otherwise("ok").alias("status"), tags.alias("tags"),
    )


def latest_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packet: the one delivered last."""
    p = table(spark, sf_dir, "packet_features")
    return p.groupBy("packet_id").agg(F.max_by(F.struct(*[c for c in p.columns if c != "packet_id"]), "ingested_at").alias("_p")).select("packet_id", "_p.*")


@query(
    "rule_decisions",
    """
WITH d AS (SELECT o_orderkey, o_totalprice, o_orderstatus, count(l_linenumber) AS n, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS returned,
  max(l_extendedprice) AS top, min(l_extendedprice) AS low FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN n = 0 THEN 'WAIT' WHEN (top - low) / top < 0.15 THEN 'USE_TOOL' WHEN returned > 0 AND o_orderstatus <> 'O' THEN 'USE_TOOL' ELSE 'ACT' END AS decision,
  o_totalprice - 1000.0 * returned AS act_reward, o_totalprice - 500.0 AS tool_reward FROM d)
SELECT o_orderkey, decision, CASE decision WHEN 'USE_TOOL' THEN CASE WHEN returned > 0 THEN 'injury_report' ELSE 'depth_chart' END END AS tool,
  CASE WHEN n = 0 THEN 'UNRESOLVABLE' WHEN tool_reward - act_reward >= 25 THEN 'HELPFUL' WHEN tool_reward - act_reward <= -25 THEN 'HARMFUL' ELSE 'UNNECESSARY' END AS counterfactual,
  returned = 0 AND n > 0 AS gate_pass FROM r""",
)
def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, the tool they ask for, and what asking would have been worth."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("l_linenumber").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.max("l_extendedprice").alias("top"), F.min("l_extendedprice").alias("low")
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    d = o.join(l.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").fillna(0, ["n", "returned"])
    r = F.col("returned")
    decision = (
        F.when(F.col("n") == 0, "WAIT").when((F.col("top") - F.col("low")) / F.col("top") < 0.15, "USE_TOOL").when((r > 0) & (F.col("o_orderstatus") != "O"), "USE_TOOL").otherwise("ACT")
    )
    gain = (F.col("o_totalprice") - 500.0) - (F.col("o_totalprice") - 1000.0 * r)
    worth = F.when(F.col("n") == 0, "UNRESOLVABLE").when(gain >= 25, "HELPFUL").when(gain <= -25, "HARMFUL").otherwise("UNNECESSARY")
    tool = F.when(decision == "USE_TOOL", F.when(r > 0, "injury_report").otherwise("depth_chart"))
    return d.select("o_orderkey", decision.alias("decision"), tool.alias("tool"), worth.alias("counterfactual"), ((r == 0) & (F.col("n") > 0)).alias("gate_pass"))


@query(
    "repair_and_universe",
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS price, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, floor(CASE WHEN price / l_quantity > 20 * p_retailprice THEN price / 100 ELSE price END * 1e2 + 0.5) / 1e2 AS price, price / l_quantity > 20 * p_retailprice AS repaired
FROM c JOIN part ON p_partkey = l_partkey WHERE p_size BETWEEN 5 AND 45""",
)
def repair_and_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that lost their decimal point are repaired; only the active universe stays."""
    broken = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 97 == 0, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice"))
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), broken.alias("price"), "l_quantity")
    p = table(spark, sf_dir, "part").where(F.col("p_size").between(5, 45)).select("p_partkey", "p_retailprice")
    lost = F.col("price") / F.col("l_quantity") > 20 * F.col("p_retailprice")
    return c.join(p, "p_partkey").select("l_orderkey", "l_linenumber", half_up(F.when(lost, F.col("price") / 100).otherwise(F.col("price")), 2).alias("price"), lost.alias("repaired"))


@query(
    "date_math",
    """
SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS monday,
  CAST(DATE '2023-09-04' + CAST(7 * (1 + user_id % 18) + 3 - 7 AS INTEGER) AS DATE) AS thursday,
  CAST(date_part('year', age(CAST(ts AS DATE), DATE '1990-01-15')) AS INTEGER) AS age, round(value, 2) AS value FROM events""",
)
def date_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch milliseconds, ISO text, week starts, the Thursday of a game week, whole years."""
    first_monday = F.next_day(F.lit("2023-09-03").cast("date"), "Mon")
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_millis(ts.cast("timestamp")).alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.trunc(F.to_date(ts), "week").alias("monday"),
        F.date_add(first_monday, (7 * (1 + F.col("user_id") % 18) - 4).cast("int")).alias("thursday"), F.floor(F.months_between(F.to_date(ts), F.lit("1990-01-15").cast("date")) / 12).cast("int").alias("age"), F.round("value", 2).alias("value"),
    )
