"""Problem 2: packets with the depth chart row that was known before their week's cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators.intervals import as_known, levels_of, supersede
from pointgate.plans.registry import query
from pointgate.session import cut, table

ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth "
    "fifteenth sixteenth seventeenth eighteenth nineteenth twentieth twenty-first twenty-second"
).split()
_ORD = "|".join(sorted(ORDINALS, key=len, reverse=True))

#: Ways a text names its own season and week: pattern, group of the season, group of the week.
MOMENTS = [
    (r"\bs(\d{4}) wk (\d{1,2})\b", 1, 2),
    (r"\b(\d{4})[- ]wk[- ](\d{1,2})\b", 1, 2),
    (r"\b(\d{4}) w(\d{1,2})\b", 1, 2),
    (r"\bw(\d{1,2})/(\d{4})\b", 2, 1),
    (r"\bwk ?(\d{1,2}) '(\d{2})\b", 2, 1),
    (rf"\bweek ({_ORD}) \((\d{{4}})\)", 2, 1),
    (rf"\b({_ORD}) week of (\d{{4}})\b", 2, 1),
    (r"\bseason (\d{4}) / week no\. (\d{1,2})\b", 1, 2),
    (r"\bthe (\d{4}) campaign, game week (\d{1,2})\b", 1, 2),
    (r"\bweek (\d{1,2}), (\d{4}) season\b", 2, 1),
]


def moment_of(text: Column, season: Column, week: Column) -> Column:
    """Season and week that a text gives for itself: struct (season, week), null where none.

    Of several the first counts that agrees with the filled column, else the first at all.
    """
    every = "|".join("(?:%s)" % p.replace("(", "(?:").replace("(?:?:", "(?:").replace(r"\(?:", r"\(") for p, _, _ in MOMENTS)
    spans = F.regexp_extract_all(F.lower(text), F.lit(f"({every})"), F.lit(1))
    words = F.create_map(*[x for i, w in enumerate(ORDINALS) for x in (F.lit(w), F.lit(i + 1))])

    def read(span: Column) -> Column:
        found = [
            F.when(
                F.regexp_extract(span, p, s) != "",
                F.struct(
                    F.regexp_extract(span, p, s).try_cast("int").alias("season"),
                    F.coalesce(F.regexp_extract(span, p, w).try_cast("int"), F.try_element_at(words, F.regexp_extract(span, p, w))).alias("week"),
                ),
            )
            for p, s, w in MOMENTS
        ]
        x = F.coalesce(*found)
        return F.struct((x["season"] + F.when(x["season"] < 100, 2000).otherwise(0)).alias("season"), x["week"].alias("week"))

    all_ = F.transform(spans, read)
    fits = F.filter(all_, lambda x: F.coalesce(x["season"] == season, F.lit(True)) & F.coalesce(x["week"] == week, F.lit(True)))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(all_, F.lit(1)))


def week_grid(games: DataFrame) -> DataFrame:
    """(season, week, cutoff, t): the moments of the season's weeks, numbered in order.

    One row for each week ever played, so the unpartitioned window is bounded by the calendar.
    The numbering stands for time, therefore cutoffs must rise with it; if they don't, the query
    fails instead of answering wrongly.
    """
    weeks = games.where(F.col("season").isNotNull() & F.col("week").isNotNull()).groupBy("season", "week").agg(F.min("gameday").alias("cutoff"))
    order = Window.orderBy("season", "week")
    g = weeks.where(F.col("cutoff").isNotNull()).select(
        "season", "week", "cutoff", (F.row_number().over(order) - 1).cast("long").alias("t"), F.lag("cutoff").over(order).alias("_before")
    )
    fine = F.col("_before").isNull() | (F.col("_before") < F.col("cutoff"))
    return g.withColumn("t", F.when(fine, F.col("t")).otherwise(F.raise_error(F.lit("cutoffs of weeks are out of order")).cast("long"))).drop("_before")


def first_after(grid: DataFrame, at: str, steps: Column, name: str) -> DataFrame:
    """Calendar (name, t): for every step between the grid's points the first point that is not before it."""
    order = Window.orderBy("t")
    spans = grid.select("t", F.col(at).alias("_hi"), F.lag(at).over(order).alias("_lo"))
    return spans.select("t", F.explode(steps).alias(name))


def depth_facts(weekly: DataFrame, snapshot: DataFrame, grid: DataFrame) -> DataFrame:
    """Depth rows as open-ended facts: player, the first week that may see the row, precedence.

    A row may be seen in weeks whose cutoff is after ``loaded_at``: cutoffs are at midnight, so
    those are the weeks whose cutoff date is after the date of ``loaded_at``.  Rows that no week
    of the grid may see are left out.
    """
    code = F.col("season") * 64 + F.col("week")
    coded = grid.withColumn("_code", code)
    # What lies before the grid counts from its first week on.
    begin = F.broadcast(coded.agg(F.min("_code").alias("_code0"), F.date_sub(F.min("cutoff"), 1).alias("_day0")))  # one row
    by_code = first_after(coded, "_code", F.sequence(F.coalesce(F.col("_lo") + 1, "_hi"), F.col("_hi")), "_code").withColumnRenamed("t", "_from")
    by_day = first_after(grid, "cutoff", F.sequence(F.coalesce("_lo", F.date_sub("_hi", 1)), F.date_sub("_hi", 1), F.expr("INTERVAL 1 DAY")), "_day")
    day = lambda c: F.greatest(F.to_date(c), "_day0")
    w = weekly.where(F.col("gsis_id").isNotNull() & F.col("loaded_at").isNotNull() & code.isNotNull()).crossJoin(begin).select(
        F.trim("gsis_id").alias("player"), F.greatest(code, "_code0").alias("_code"), day("loaded_at").alias("_day"), "loaded_at", "depth_id", code.cast("long").alias("rank")
    )
    w = w.join(F.broadcast(by_code), "_code").select("player", "_day", "loaded_at", "depth_id", "rank", "_from")
    s = snapshot.where(F.col("gsis_id").isNotNull() & F.col("loaded_at").isNotNull() & F.col("dt").isNotNull()).crossJoin(begin).select(
        F.trim("gsis_id").alias("player"), day("loaded_at").alias("_day"), "loaded_at", "depth_id", F.unix_micros(F.col("dt").cast("timestamp")).alias("rank"), day("dt").alias("_on")
    )
    s = s.join(F.broadcast(by_day.select(F.col("_day").alias("_on"), F.col("t").alias("_from"))), "_on")
    both = w.unionByName(s.select(*w.columns)).join(F.broadcast(by_day), "_day")
    return both.select("player", F.greatest("_from", "t").alias("since"), "rank", "loaded_at", "depth_id")


def placed_packets(packets: DataFrame, grid: DataFrame) -> DataFrame:
    """(packet_id, player, t) of each packet whose player, season and week can be told."""
    given = F.struct("season", "week", "player_id", "text")
    one = packets.where(F.col("packet_id").isNotNull()).groupBy("packet_id").agg(
        F.max_by(given, F.struct(F.col("ingested_at"), F.col("season"), F.col("week"), F.col("player_id"), F.col("text"))).alias("_p")
    )
    p = one.select("packet_id", "_p.*")
    said = F.when(F.col("season").isNull() | F.col("week").isNull(), moment_of(F.col("text"), F.col("season"), F.col("week")))
    p = p.select("packet_id", F.trim("player_id").alias("player"), "season", "week", said.alias("_m"))
    p = p.select("packet_id", "player", F.coalesce("season", "_m.season").alias("season"), F.coalesce("week", "_m.week").alias("week"))
    return p.join(F.broadcast(grid.select("season", "week", "t")), ["season", "week"]).select("packet_id", "player", "t")


P2_SQL = (
    """
WITH grid AS (SELECT season, week, CAST(min(gameday) AS TIMESTAMP) AS cutoff FROM games GROUP BY 1, 2),
raw AS (SELECT DISTINCT packet_id, season, week, trim(player_id) AS player, lower(text) AS x FROM packet_features),
said AS (SELECT packet_id, season, week, player, """
    + "COALESCE("
    + ", ".join("nullif(regexp_extract(x, '%s', %d), '')" % (p.replace("'", "''"), s) for p, s, _ in MOMENTS)
    + ") AS xs, COALESCE("
    + ", ".join("nullif(regexp_extract(x, '%s', %d), '')" % (p.replace("'", "''"), w) for p, _, w in MOMENTS)
    + ") AS xw FROM raw),\nplaced AS (SELECT packet_id, player, COALESCE(season, CASE WHEN TRY_CAST(xs AS INT) < 100 THEN 2000 + TRY_CAST(xs AS INT) ELSE TRY_CAST(xs AS INT) END) AS season, "
    + "COALESCE(week, TRY_CAST(xw AS INT), CASE xw "
    + " ".join(f"WHEN '{w}' THEN {i + 1}" for i, w in enumerate(ORDINALS))
    + " END) AS week FROM said),\n"
    + """known AS (SELECT p.packet_id, p.player, p.season, p.week, g.cutoff FROM placed p JOIN grid g USING (season, week)),
cand AS (
  SELECT a.packet_id, d.depth_id, CAST(d.season * 64 + d.week AS BIGINT) AS rank, d.loaded_at FROM known a JOIN depth_weekly d ON trim(d.gsis_id) = a.player
  WHERE d.loaded_at < a.cutoff AND d.season * 64 + d.week <= a.season * 64 + a.week
  UNION ALL
  SELECT a.packet_id, d.depth_id, epoch_us(d.dt) AS rank, d.loaded_at FROM known a JOIN depth_snapshot d ON trim(d.gsis_id) = a.player
  WHERE d.loaded_at < a.cutoff AND d.dt < a.cutoff)
SELECT packet_id, depth_id FROM cand
QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY rank DESC, loaded_at DESC, depth_id DESC) = 1
"""
)


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet_id, depth_id) of each packet that has a depth row known before its week's cutoff."""
    grid = cut(week_grid(table(spark, sf_dir, "games")))  # a row a week, used many times
    facts = depth_facts(table(spark, sf_dir, "depth_weekly"), table(spark, sf_dir, "depth_snapshot"), grid)
    order = ["rank", "loaded_at", "depth_id"]
    levels = levels_of(grid.count())
    facts = supersede(facts, "player", "since", order, 2**levels)
    packets = cut(placed_packets(table(spark, sf_dir, "packet_features"), grid))
    return as_known(
        packets, facts, key="player", event_id="packet_id", time="t", start="since", end="_until", precedence=order, levels=levels
    ).select("packet_id", "depth_id")
