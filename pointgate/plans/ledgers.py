"""Canonical rows, usage and cost ledgers, flags, pair histories and label quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.functions import replies
from pointgate.functions.ranges import in_ranges, whole_numbers
from pointgate.operators import scoring as sc
from pointgate.operators.joins import null_safe_join
from pointgate.plans.extras import _BEST, best
from pointgate.plans.registry import query
from pointgate.plans.texts import _SAID, said
from pointgate.session import table
from pointgate.sources.files import replace_atomically, scratch


@query(
    "canonical_docs",
    """SELECT CASE WHEN coalesce(source_key, '') <> '' THEN coalesce(source, 'unknown') || ':' || source_key ELSE 'made:' || substr(sha1(coalesce(player_id, '') || '|' || published_ms || '|' || coalesce(title, '')), 1, 16) END AS doc_id,
  nullif(player_id, '') AS player_id, strftime(make_timestamp(published_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS published_utc, coalesce(source, 'unknown') AS source, concat_ws(' ', nullif(trim(title, ' '), ''), nullif(trim(text, ' '), '')) AS text, true AS internal_research_only
FROM documents WHERE published_ms > 0""",
)
def canonical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as canonical rows: an id of source and key, or one made of the row; UTC text of the milliseconds; fields joined to one text.

    Rows without a time are left out.
    """
    d = table(spark, sf_dir, "documents").where(F.col("published_ms") > 0)
    source = F.coalesce("source", F.lit("unknown"))
    made = F.concat(F.lit("made:"), F.left(F.sha1(F.concat_ws("|", F.coalesce("player_id", F.lit("")), F.col("published_ms"), F.coalesce("title", F.lit(""))).cast("binary")), F.lit(16)))
    key = F.when(F.coalesce("source_key", F.lit("")) != "", F.concat(source, F.lit(":"), "source_key")).otherwise(made)
    at = F.date_format(F.timestamp_millis("published_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.concat_ws(" ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    return d.select(key.alias("doc_id"), F.nullif("player_id", F.lit("")).alias("player_id"), at.alias("published_utc"), source.alias("source"), text.alias("text"), F.lit(True).alias("internal_research_only"))


#: Kinds of usage events and the column that they add to; a kind of no column is known and free.
USAGE = {"purchase": "bought", "view": "seen", "click": "clicked", "signup": "joined", "error": None}


def usage_by_kind(events: DataFrame, *, kind: str, amount: str, at: str, start: str, end: str, kinds: dict[str, str | None], by: list[str]) -> DataFrame:
    """One row for each ``by`` with the sums of every kind from ``start`` until before ``end``; an unknown kind fails."""
    x = events.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))
    known = F.when(F.col(kind).isin(*kinds), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unexpected kind of event: "), F.coalesce(kind, F.lit("null")))))
    x = x.withColumn("_kind", known)
    return x.groupBy(*by).agg(*[F.round(F.sum(F.when(F.col("_kind") == k, F.coalesce(amount, F.lit(0.0))).otherwise(0.0)), 4).alias(c) for k, c in kinds.items() if c])


@query(
    "usage_pivot",
    "SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN event_type = '{k}' THEN coalesce(value, 0) ELSE 0 END), 4) AS {c}" for k, c in USAGE.items() if c) + " FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1",
)
def usage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of each user by kind within a window of time."""
    return usage_by_kind(table(spark, sf_dir, "events"), kind="event_type", amount="value", at="ts", start="2024-01-05", end="2024-01-25", kinds=USAGE, by=["user_id"])


#: Price of a unit by kind.
PRICES = {"purchase": 0.02, "view": 0.001, "click": 0.004, "signup": 0.1}


@query(
    "cost_ledger",
    f"""WITH e AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PRICES.items())} END AS price FROM events)
SELECT event_type, count(*) AS n, count(value * price) AS known_cost_n, round(sum(value), 4) AS units, round(sum(value * price), 4) AS cost, round(avg(epoch(ts) - epoch(date_trunc('day', ts))), 3) AS mean_latency FROM e GROUP BY 1""",
)
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind: number, those of known cost, units, units times the price of the kind, mean seconds since midnight."""
    price = F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])
    e = table(spark, sf_dir, "events").withColumn("_cost", F.col("value") * F.try_element_at(price, F.col("event_type")))
    late = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")) / 1e6
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("_cost").alias("known_cost_n"), F.round(F.sum("value"), 4).alias("units"), F.round(F.sum("_cost"), 4).alias("cost"), F.round(F.avg(late), 3).alias("mean_latency"))


def reconciled(provider: DataFrame, completed: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, provider, completed, open): what the provider counts beyond the completed; less than nothing is an error."""
    a = provider.groupBy(key).agg(F.sum(value).alias("provider"))
    b = completed.groupBy(key).agg(F.sum(value).alias("completed"))
    x = null_safe_join(a, b, [key], "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    left = F.round(F.col("provider") - F.col("completed"), 4)
    return x.select(key, "provider", "completed", F.when(left >= 0, left).otherwise(F.raise_error(F.concat(F.lit("more completed than provided: "), F.col(key).cast("string")))).alias("open"))


@query("ledger_open", "SELECT o_orderpriority, provider::DOUBLE AS provider, completed::DOUBLE AS completed, (provider - completed)::DOUBLE AS open FROM (SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS provider, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END), 0) AS completed FROM orders GROUP BY 1)")
def ledger_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything ordered less everything completed, by priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    x = reconciled(o, o.where("o_orderstatus = 'F'"), key="o_orderpriority", value="o_totalprice")
    return x.select("o_orderpriority", *[F.col(c).cast("double").alias(c) for c in ("provider", "completed", "open")])


@query("range_spec", f"WITH b AS ({_BEST}) SELECT season, count(*) AS rows, count(DISTINCT player_id) AS players FROM b WHERE season IN (2015, 2016, 2017, 2018, 2021) GROUP BY 1")
def range_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of a written range."""
    return best(spark, sf_dir).where(in_ranges(F.col("season"), "2015-2018, 2021")).groupBy("season").agg(F.count("*").alias("rows"), F.count_distinct("player_id").alias("players"))


@query("range_numbers", "SELECT doc_id, list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]{1,4}'), lambda x: x::BIGINT))::BIGINT AS total, len(regexp_extract_all(coalesce(text, ''), '[0-9]{1,4}')) AS n FROM documents WHERE regexp_matches(text, '[0-9]')")
def range_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that texts hold, read as a written range of single numbers."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    spec = F.array_join(F.regexp_extract_all("text", F.lit("([0-9]{1,4})"), F.lit(1)), ",")
    x = d.select("doc_id", whole_numbers(spec).alias("v"))
    return x.select("doc_id", F.aggregate("v", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size("v").cast("long").alias("n"))


_FLAGGED = "SELECT player_id, season, bool_or(coalesce(changed_team, false)) AS flag FROM packet_features WHERE player_id IS NOT NULL AND season IS NOT NULL GROUP BY 1, 2"


@query(
    "flag_join",
    f"""WITH b AS ({_BEST}), f AS ({_FLAGGED}), p AS (SELECT b.*, f.flag, b.finish <= 24 AS hit FROM b LEFT JOIN f ON f.player_id = b.player_id AND f.season = b.season)
SELECT season, count(*) AS candidates, count_if(flag IS NULL) AS unmatched, coalesce(count_if(flag), 0) AS flagged, coalesce(count_if(flag AND hit), 0) AS flagged_hits, coalesce(count_if(NOT flag), 0) AS others, coalesce(count_if(NOT flag AND hit), 0) AS other_hits,
  round(count_if(flag AND hit) / nullif(count_if(flag), 0), 6) AS flagged_rate, round(count_if(NOT flag AND hit) / nullif(count_if(NOT flag), 0), 6) AS other_rate FROM p GROUP BY 1""",
)
def flag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag joined to the candidates of a season; those without one are counted and left out of the rates."""
    f = table(spark, sf_dir, "packet_features").where(F.col("player_id").isNotNull() & F.col("season").isNotNull()).groupBy("player_id", "season").agg(F.bool_or(F.coalesce("changed_team", F.lit(False))).alias("flag"))
    p = best(spark, sf_dir).join(f, ["player_id", "season"], "left").withColumn("hit", F.col("finish") <= 24)
    flag, hit = F.col("flag"), F.col("hit")
    return p.groupBy("season").agg(
        F.count("*").alias("candidates"), F.count_if(flag.isNull()).alias("unmatched"), F.count_if(flag).alias("flagged"), F.count_if(flag & hit).alias("flagged_hits"), F.count_if(~flag).alias("others"), F.count_if(~flag & hit).alias("other_hits"),
        F.round(F.try_divide(F.count_if(flag & hit), F.count_if(flag)), 6).alias("flagged_rate"), F.round(F.try_divide(F.count_if(~flag & hit), F.count_if(~flag)), 6).alias("other_rate"),
    )


_PAIRED = f"""b AS ({_BEST}), q AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY ppr / nullif(games, 0) DESC NULLS LAST, player_id) AS r, ppr / nullif(games, 0) AS ppg FROM b),
h AS (SELECT x.season, x.position, (x.ppg - y.ppg) / nullif(greatest(x.ppg, y.ppg), 0) AS edge, CASE WHEN x.ppr > y.ppr THEN 1 ELSE 0 END AS outcome FROM q x JOIN q y ON x.season = y.season AND x.position = y.position AND y.r = x.r + 1 WHERE x.r % 2 = 1 AND x.ppg - y.ppg <= 0.2::DOUBLE * greatest(x.ppg, y.ppg))"""


@query(
    "pair_history",
    f"""WITH {_PAIRED}, g AS (SELECT season, count(*) AS n, sum(outcome) AS wins, sum(edge) AS edges FROM h GROUP BY 1), s AS (SELECT DISTINCT season FROM b)
SELECT s.season, coalesce(sum(g.n), 0)::BIGINT AS pairs, round(sum(g.wins) / nullif(sum(g.n), 0), 6) AS rate, round(sum(g.edges) / nullif(sum(g.n), 0), 6) AS mean_edge FROM s LEFT JOIN g ON g.season < s.season GROUP BY 1""",
)
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-to-head pairs (neighbours within 20 % of each other) accumulated over all seasons strictly before each."""
    q = best(spark, sf_dir).withColumn("ppg", F.try_divide("ppr", "games"))
    order = Window.partitionBy("season", "position").orderBy(F.col("ppg").desc_nulls_last(), "player_id")
    nxt = lambda c: F.lead(c).over(order)
    h = q.select("season", "ppg", "ppr", nxt("ppg").alias("ppg_b"), nxt("ppr").alias("ppr_b"), F.row_number().over(order).alias("r")).where((F.col("r") % 2 == 1) & (F.col("ppg") - F.col("ppg_b") <= 0.2 * F.greatest("ppg", "ppg_b")))
    edge = F.try_divide(F.col("ppg") - F.col("ppg_b"), F.greatest("ppg", "ppg_b"))
    g = h.groupBy("season").agg(F.count("*").alias("n"), F.sum((F.col("ppr") > F.col("ppr_b")).cast("int")).alias("wins"), F.sum(edge).alias("edges"))
    before = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row a season
    x = q.select("season").distinct().join(g, "season", "left")
    total = lambda c: F.sum(c).over(before)
    return x.select("season", F.coalesce(total("n"), F.lit(0)).alias("pairs"), F.round(F.try_divide(total("wins"), total("n")), 6).alias("rate"), F.round(F.try_divide(total("edges"), total("n")), 6).alias("mean_edge"))


@query(
    "sensitivity_probe",
    f"""WITH b AS ({_BEST}), z AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY ppr DESC, player_id) AS r, avg(ppr) OVER (PARTITION BY player_id ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM b WHERE ppr IS NOT NULL),
p AS (SELECT x.season, x.games AS m1, y.games AS m2, x.past AS r1, y.past AS r2, sha256(x.season || ':' || x.position || ':' || ((x.r + 1) // 2)) < '8' AS swapped FROM z x JOIN z y ON x.season = y.season AND x.position = y.position AND y.r = x.r + 1 WHERE x.r % 2 = 1),
c AS (SELECT CASE WHEN season <= 2016 THEN 'early' ELSE 'late' END AS era, swapped, CASE WHEN m1 > m2 THEN 1.0 WHEN m1 = m2 THEN 0.5 WHEN m1 < m2 THEN 0.0 END AS model, CASE WHEN r1 > r2 THEN 1.0 WHEN r1 = r2 THEN 0.5 WHEN r1 < r2 THEN 0.0 END AS ref FROM p),
s AS (SELECT coalesce(era, 'all') AS era, avg(CASE WHEN NOT swapped THEN model END) AS mc, avg(CASE WHEN swapped THEN 1 - model END) AS ms, avg(CASE WHEN NOT swapped THEN ref END) AS rc, avg(CASE WHEN swapped THEN 1 - ref END) AS rs, count(model) AS n_model, count(ref) AS n_ref FROM c GROUP BY GROUPING SETS ((era), ()))
SELECT era, n_model, n_ref, round(mc, 6) AS model_control, round(mc - ms, 6) AS model_index, round(rc, 6) AS ref_control, round(rc - rs, 6) AS ref_index FROM s""",
)
def sensitivity_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair accuracy of a forecast (games played) against a reference that knows the past only, by era.

    Within a pair of neighbours the order counts 1, a tie a half; pairs that lack a forecast drop out.
    In swapped pairs the packet is followed, not the player; the index is the accuracy of the control
    pairs less that of the swapped ones.
    """
    b = best(spark, sf_dir).where(F.col("ppr").isNotNull())
    past = F.avg("ppr").over(Window.partitionBy("player_id").orderBy("season").rangeBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy("season", "position").orderBy(F.col("ppr").desc(), "player_id")
    z = b.withColumn("past", past).select("season", "position", F.row_number().over(order).alias("r"), F.col("games").alias("m1"), F.lead("games").over(order).alias("m2"), F.col("past").alias("r1"), F.lead("past").over(order).alias("r2"), F.lead("player_id").over(order).alias("other"))
    p = z.where((F.col("r") % 2 == 1) & F.col("other").isNotNull())
    swapped = F.sha2(F.concat_ws(":", F.col("season").cast("string"), "position", F.floor((F.col("r") + 1) / 2).cast("string")), 256) < "8"
    credit = lambda a, c: F.when(F.col(a) > F.col(c), 1.0).when(F.col(a) == F.col(c), 0.5).when(F.col(a) < F.col(c), 0.0)
    c = p.select(F.when(F.col("season") <= 2016, "early").otherwise("late").alias("era"), swapped.alias("swapped"), credit("m1", "m2").alias("model"), credit("r1", "r2").alias("ref"))
    arm = lambda x, s: F.avg(F.when(F.col("swapped") if s else ~F.col("swapped"), 1 - F.col(x) if s else F.col(x)))
    g = c.groupingSets([["era"], []], "era").agg(F.count("model").alias("n_model"), F.count("ref").alias("n_ref"), arm("model", False).alias("mc"), arm("model", True).alias("ms"), arm("ref", False).alias("rc"), arm("ref", True).alias("rs"))
    return g.select(F.coalesce("era", F.lit("all")).alias("era"), "n_model", "n_ref", F.round("mc", 6).alias("model_control"), F.round(F.col("mc") - F.col("ms"), 6).alias("model_index"), F.round("rc", 6).alias("ref_control"), F.round(F.col("rc") - F.col("rs"), 6).alias("ref_index"))


@query(
    "label_quality",
    rf"""WITH a AS (SELECT row_id, t11_subtype, {_SAID.format('user')} AS u, {_SAID.format('assistant')} AS r FROM t11_targeted_v1),
b AS (SELECT row_id, t11_subtype, u, json_extract_string(TRY_CAST(CASE WHEN r LIKE '{{%' THEN r END AS JSON), '$.pick') AS pick FROM a),
v AS (SELECT row_id, t11_subtype, pick, unnest(regexp_extract_all(u, '(P[0-9]{{3}}) (?:QB|RB|WR|TE) [0-9.]+ [0-9.]+ [0-9.]+', 1)) AS player, unnest(regexp_extract_all(u, 'P[0-9]{{3}} (?:QB|RB|WR|TE) ([0-9.]+) [0-9.]+ [0-9.]+', 1))::DOUBLE AS adp FROM b WHERE pick IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY adp, player) AS rank FROM v), m AS (SELECT row_id, t11_subtype, min(rank) AS rank FROM k WHERE player = pick GROUP BY 1, 2)
SELECT t11_subtype, count(*) AS picks, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS leader_share, median(rank) AS median_rank FROM m GROUP BY 1""",
)
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a pick is the cheapest player on view, and the median rank of picks among those on view."""
    a = table(spark, sf_dir, "t11_targeted_v1").select("row_id", "t11_subtype", said("user").alias("u"), replies.action(said("assistant"))["pick"].alias("pick")).where(F.col("pick").isNotNull())
    at = lambda g: F.regexp_extract_all("u", F.lit(r"(P[0-9]{3}) (?:QB|RB|WR|TE) ([0-9.]+) [0-9.]+ [0-9.]+"), F.lit(g))
    view = F.array_sort(F.zip_with(at(2), at(1), lambda adp, p: F.struct(adp.cast("double").alias("adp"), p.alias("player"))))
    x = a.select("t11_subtype", F.array_position(F.transform(view, lambda v: v["player"]), F.col("pick")).alias("rank")).where(F.col("rank") > 0)
    return x.groupBy("t11_subtype").agg(F.count("*").alias("picks"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("leader_share"), F.median("rank").alias("median_rank"))


@query(
    "position_labels",
    f"""WITH b AS ({_BEST}), d AS (SELECT season, player_id, position, min(adp) AS adp FROM draftbench WHERE preset = 'ppr' AND adp IS NOT NULL AND nflverse_id IS NOT NULL AND position IN ('QB', 'RB', 'WR', 'TE') GROUP BY 1, 2, 3),
i AS (SELECT season, player_id, min(nflverse_id) AS real FROM draftbench WHERE nflverse_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT d.*, real, row_number() OVER (PARTITION BY d.season, d.position ORDER BY adp, d.player_id) AS market FROM d JOIN i USING (season, player_id)),
x AS (SELECT m.season, m.player_id, m.position, market, finish, games FROM m LEFT JOIN (SELECT season, player_id, min(finish) AS finish, max(games) AS games FROM b GROUP BY 1, 2) b ON b.season = m.season AND b.player_id = m.real)
SELECT season, player_id, position, market - finish AS alpha, coalesce(finish <= CASE WHEN position IN ('QB', 'TE') THEN 12 ELSE 24 END AND market > CASE WHEN position IN ('QB', 'TE') THEN 18 ELSE 40 END, false) AS breakout,
  coalesce(market <= 12 AND (finish IS NULL OR finish > 24), false) AS bust, coalesce(market <= 12 AND finish > 24 AND games < 8, false) AS injury_bust FROM x""",
)
def position_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakout, bust, injury bust and alpha of claimed board players, by the gates of their position."""
    d = table(spark, sf_dir, "draftbench")
    real = d.where(F.col("nflverse_id").isNotNull()).groupBy("season", "player_id").agg(F.min("nflverse_id").alias("real"))
    m = d.where((F.col("preset") == "ppr") & F.col("adp").isNotNull() & F.col("nflverse_id").isNotNull() & F.col("position").isin(*sc.FINISH_GATE)).groupBy("season", "player_id", "position").agg(F.min("adp").alias("adp"))
    m = m.join(real, ["season", "player_id"]).withColumn("market", F.row_number().over(Window.partitionBy("season", "position").orderBy("adp", "player_id")))
    o = best(spark, sf_dir).groupBy("season", F.col("player_id").alias("real")).agg(F.min("finish").alias("finish"), F.max("games").alias("games"))
    x = m.join(o, ["season", "real"], "left")
    return x.select("season", "player_id", "position", sc.position_label(F.col("position"), F.col("market"), F.col("finish"), F.col("games")).alias("x")).select("season", "player_id", "position", "x.*")


@query("atomic_replace", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def atomic_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, replaced as a whole by a rename, and read back: the second version."""
    path = scratch(spark, "replaced")
    o = table(spark, sf_dir, "orders")
    for part in (o.where("o_orderstatus = 'F'"), o):
        replace_atomically(part.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query(
    "action_parse",
    rf"""WITH a AS (SELECT row_id, t11_subtype, {_SAID.format('assistant')} AS r FROM t11_targeted_v1), o AS (SELECT row_id, TRY_CAST(nullif(regexp_extract(r, '(?s)(\{{.*\}})', 1), '') AS JSON) AS j FROM a)
SELECT row_id, CASE WHEN j IS NULL THEN 'none' WHEN json_extract_string(j, '$.pick') IS NOT NULL THEN 'pick' WHEN json_extract_string(j, '$.tool.name') IS NOT NULL THEN 'tool' ELSE 'invalid' END AS kind, json_extract_string(j, '$.pick') AS pick,
  CASE WHEN json_extract_string(j, '$.pick') IS NULL THEN json_extract_string(j, '$.tool.name') END AS tool FROM o""",
)
def action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced object of every reply as an action."""
    a = table(spark, sf_dir, "t11_targeted_v1").select("row_id", replies.action(said("assistant")).alias("x"))
    return a.select("row_id", "x.kind", "x.pick", "x.tool")


@query(
    "anchor_choice",
    """WITH g AS (SELECT source, lang, avg(n_chars) AS r1, count(n_chars) AS n1 FROM documents GROUP BY 1, 2), s AS (SELECT source, avg(n_chars) AS r2, count(n_chars) AS n2 FROM documents GROUP BY 1)
SELECT g.source, g.lang, round(CASE WHEN r1 IS NOT NULL AND n1 >= 20 THEN r1 WHEN r2 IS NOT NULL AND n2 >= 20 THEN r2 WHEN r1 IS NULL THEN r2 WHEN r2 IS NULL THEN r1 WHEN n1 >= n2 THEN r1 ELSE r2 END, 4) AS rate,
  CASE WHEN r1 IS NOT NULL AND n1 >= 20 THEN n1 WHEN r2 IS NOT NULL AND n2 >= 20 THEN n2 WHEN r1 IS NULL THEN coalesce(CASE WHEN r2 IS NULL THEN 0 ELSE n2 END, 0) WHEN r2 IS NULL THEN n1 WHEN n1 >= n2 THEN n1 ELSE n2 END AS n FROM g LEFT JOIN s ON s.source IS NOT DISTINCT FROM g.source""",
)
def anchor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean length of a source and language if 20 rows support it, else of the source, else what most rows support."""
    d = table(spark, sf_dir, "documents")
    g = d.groupBy("source", "lang").agg(F.avg("n_chars").alias("r1"), F.count("n_chars").alias("n1"))
    x = null_safe_join(g, d.groupBy("source").agg(F.avg("n_chars").alias("r2"), F.count("n_chars").alias("n2")), ["source"], "left")
    a = replies.anchor([(F.col("r1"), F.col("n1")), (F.col("r2"), F.col("n2"))])
    return x.select("source", "lang", a.alias("a")).select("source", "lang", F.round("a.rate", 4).alias("rate"), "a.n")
