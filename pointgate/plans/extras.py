"""Validators, set algebra, rollups and smaller matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.functions import text as tx
from pointgate.functions.names import coach_name
from pointgate.operators.matching import greedy_nearest
from pointgate.plans.registry import query
from pointgate.plans.texts import _SAID, said
from pointgate.session import table

_BEST = "SELECT season, player_id, position, max(total_ppr) AS ppr, max(games) AS games, min(pos_season_rank_ppr) AS finish FROM season_points GROUP BY 1, 2, 3"


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "season_points")
    return s.groupBy("season", "player_id", "position").agg(F.max("total_ppr").alias("ppr"), F.max("games").alias("games"), F.min("pos_season_rank_ppr").alias("finish"))


@query(
    "response_validator",
    rf"""WITH a AS (SELECT row_id, {_SAID.format('user')} AS u, {_SAID.format('assistant')} AS r FROM t11_targeted_v1 WHERE bench = 'draftgym'),
b AS (SELECT row_id, regexp_extract_all(u, '(P[0-9]{{3}}) (?:QB|RB|WR|TE) [0-9.]+', 1) AS visible, CASE WHEN r LIKE '{{%' THEN json_extract_string(TRY_CAST(r AS JSON), '$.pick') END AS pick FROM a)
SELECT row_id, CASE WHEN pick IS NULL THEN 'no pick' WHEN list_contains(visible, pick) THEN 'legal' ELSE 'not visible' END AS verdict FROM b""",
)
def response_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply picks a player that the observation shows."""
    a = table(spark, sf_dir, "t11_targeted_v1").where("bench = 'draftgym'").select("row_id", said("user").alias("u"), said("assistant").alias("r"))
    visible = F.regexp_extract_all("u", F.lit(r"(P[0-9]{3}) (?:QB|RB|WR|TE) [0-9.]+"), F.lit(1))
    pick = F.when(F.startswith("r", F.lit("{")), F.get_json_object("r", "$.pick"))
    return a.select("row_id", F.when(pick.isNull(), "no pick").when(F.array_contains(visible, pick), "legal").otherwise("not visible").alias("verdict"))


@query(
    "future_dates",
    rf"""WITH d AS (SELECT row_id, season, unnest(regexp_extract_all({_SAID.format('user')}, '(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1)) AS said FROM t11_targeted_v1)
SELECT season, count(*) AS dates, count_if(TRY_CAST(said AS DATE) >= make_date(season, 9, 1)) AS not_before_gate, max(TRY_CAST(said AS DATE)) AS latest FROM d WHERE season IS NOT NULL GROUP BY 1""",
)
def future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in prompts that a gate of 1 September should have kept out."""
    d = table(spark, sf_dir, "t11_targeted_v1").where(F.col("season").isNotNull()).select("season", F.explode(F.regexp_extract_all(said("user"), F.lit(r"(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9])"), F.lit(1))).alias("said"))
    at = F.try_to_date("said", "yyyy-MM-dd")
    return d.groupBy("season").agg(F.count("*").alias("dates"), F.count_if(at >= F.make_date("season", F.lit(9), F.lit(1))).alias("not_before_gate"), F.max(at).alias("latest"))


@query(
    "set_algebra",
    f"""WITH b AS ({_BEST}), c AS (SELECT DISTINCT season + 1 AS season, player_id FROM b WHERE finish <= 12), a AS (SELECT DISTINCT season, player_id FROM b WHERE finish <= 12), u AS (SELECT * FROM c UNION SELECT * FROM a), i AS (SELECT * FROM c INTERSECT SELECT * FROM a), e AS (SELECT * FROM a EXCEPT SELECT * FROM c)
SELECT season, count(*) AS pool, (SELECT count(*) FROM i WHERE i.season = u.season) AS both, (SELECT count(*) FROM e WHERE e.season = u.season) AS new FROM u GROUP BY 1""",
)
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of expected and actual leaders, those in both, and the new ones."""
    b = best(spark, sf_dir).where("finish <= 12")
    c, a = b.select((F.col("season") + 1).alias("season"), "player_id"), b.select("season", "player_id")
    mark = lambda df, name: df.groupBy("season").agg(F.count("*").alias(name))
    out = mark(c.union(a).distinct(), "pool").join(mark(c.intersect(a), "both"), "season", "left").join(mark(a.subtract(c), "new"), "season", "left")
    return out.fillna(0, ["both", "new"])


@query("histogram_top", "SELECT source, lang, count(*) AS n FROM (SELECT source, coalesce(lang, '') AS lang FROM documents) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) <= 5")
def histogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent languages of each source."""
    g = table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "lang"))).where("r <= 5").drop("r")


@query("nearest_match")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movers matched to the nearest stayers of season and position by games and points, each used once.

    Candidates are those within 25 points, the nearest pair first.
    """
    s = table(spark, sf_dir, "season_points").groupBy("season", "player_id", "position").agg(F.max("total_ppr").alias("ppr"), F.bool_or(F.contains("team", F.lit("/"))).alias("moved"))
    x = greedy_nearest(s, by=["season", "position"], id="player_id", value="ppr", side="moved", within=25)
    return x.select("season", "position", "a", "b", F.round("distance", 2).alias("distance"))


@query(
    "digest_verify",
    "SELECT split_name, count(*) AS rows, true AS same FROM eval_items GROUP BY 1",
)
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of a frozen table, taken twice over different layouts, must agree."""
    t = table(spark, sf_dir, "eval_items")
    digest = lambda df, name: df.groupBy("split_name").agg(F.count("*").alias(f"{name}_n"), F.bit_xor(F.xxhash64("item_id", "family", "season", "text")).alias(name))
    x = digest(t, "a").join(digest(t.repartition("item_id"), "b"), "split_name")
    return x.select("split_name", F.col("a_n").alias("rows"), ((F.col("a") == F.col("b")) & (F.col("a_n") == F.col("b_n"))).alias("same"))


@query("html_table_melt", f"WITH b AS ({_BEST}) SELECT season, position, player_id, round(ppr, 2) AS ppr FROM b WHERE finish <= 5 AND ppr >= 0")
def html_table_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in HTML with seasons as columns, of the five best of a position, read back to one row for each filled cell."""
    return melted(best(spark, sf_dir).where("finish <= 5 and ppr >= 0"))


@query("html_table_melt_all", f"WITH b AS ({_BEST}) SELECT season, position, player_id, round(ppr, 2) AS ppr FROM b WHERE season IS NOT NULL AND ppr IS NOT NULL")
def html_table_melt_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``html_table_melt`` over every player season."""
    return melted(best(spark, sf_dir))


def melted(b: DataFrame) -> DataFrame:
    """Filled cells of the HTML tables of ``b``; the columns are the seasons that stand in it, a bounded vocabulary."""
    b = b.where(F.col("season").isNotNull() & F.col("ppr").isNotNull())
    seasons = sorted(r["season"] for r in b.select("season").distinct().collect())
    if not seasons:
        return b.select("season", "position", "player_id", "ppr")
    wide = b.groupBy("player_id", "position").pivot("season", seasons).agg(F.first(F.format_string("%.2f", F.round("ppr", 2))))
    head = F.lit("<tr>" + "".join(f"<th>{s}</th>" for s in seasons) + "</tr>")
    cells = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(F.col(str(s)), F.lit("")), F.lit("</td>")) for s in seasons])
    page = wide.select("player_id", "position", F.concat(head, F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))
    names, values = F.regexp_extract_all("html", F.lit("<th>([0-9]+)</th>"), F.lit(1)), F.regexp_extract_all("html", F.lit("<td>([^<]*)</td>"), F.lit(1))
    x = page.select("player_id", "position", F.explode(F.arrays_zip(names.alias("s"), values.alias("v"))).alias("c")).where(F.col("c.v") != "")
    return x.select(F.col("c.s").cast("int").alias("season"), "position", "player_id", F.col("c.v").cast("double").alias("ppr"))


@query(
    "probability_diagnostics",
    """WITH l AS (SELECT l_returnflag AS family, least(greatest(l_quantity / 60.0 + l_discount, 0.02), 0.98) AS p, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT family, count_if((p >= 0.8 AND y = 0) OR (p <= 0.2 AND y = 1)) AS confident_wrong, count_if(abs(p - 0.5) > 0.3) AS extreme, round(avg(abs(p - y)), 6) AS mean_error FROM l GROUP BY 1""",
)
def probability_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointgate.plans.metrics import labelled

    p, y = F.col("p"), F.col("y")
    return labelled(spark, sf_dir).groupBy("family").agg(F.count_if(((p >= 0.8) & (y == 0)) | ((p <= 0.2) & (y == 1))).alias("confident_wrong"), F.count_if(F.abs(p - 0.5) > 0.3).alias("extreme"), F.round(F.avg(F.abs(p - y)), 6).alias("mean_error"))


@query(
    "bust_crosstab",
    f"""WITH b AS ({_BEST}), x AS (SELECT b.season, b.position, CASE WHEN b.games < 8 THEN 'injury' WHEN b.finish > 24 THEN 'performance' ELSE 'none' END AS class FROM b JOIN b a ON a.player_id = b.player_id AND a.season = b.season - 1 AND a.finish <= 12)
SELECT coalesce(CAST(season AS VARCHAR), 'all') AS season, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY season), 6) AS share FROM x GROUP BY GROUPING SETS ((season, class), (class))""",
)
def bust_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How earlier leaders fell, per season and pooled."""
    b = best(spark, sf_dir)
    a = b.where("finish <= 12").select((F.col("season") + 1).alias("season"), "player_id")
    x = b.join(a, ["season", "player_id"]).select("season", F.when(F.col("games") < 8, "injury").when(F.col("finish") > 24, "performance").otherwise("none").alias("class"))
    g = x.groupingSets([["season", "class"], ["class"]], "season", "class").agg(F.count("*").alias("n"))
    return g.select(F.coalesce(F.col("season").cast("string"), F.lit("all")).alias("season"), "class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("season")), 6).alias("share"))


@query(
    "consensus_order",
    """WITH d AS (SELECT season, preset, player_id, position, min(adp) AS adp FROM draftbench WHERE adp IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY season, preset ORDER BY adp, player_id) AS pos FROM d)
SELECT season, position, player_id, CAST(min(pos) AS BIGINT) AS first_seen, row_number() OVER (PARTITION BY season, position ORDER BY avg(adp), player_id) AS consensus FROM r GROUP BY 1, 2, 3""",
)
def consensus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consensus rank per position, and the first place at which any list names the player."""
    d = table(spark, sf_dir, "draftbench").where(F.col("adp").isNotNull()).groupBy("season", "preset", "player_id", "position").agg(F.min("adp").alias("adp"))
    r = d.withColumn("pos", F.row_number().over(Window.partitionBy("season", "preset").orderBy("adp", "player_id")))
    g = r.groupBy("season", "position", "player_id").agg(F.min("pos").cast("long").alias("first_seen"), F.avg("adp").alias("adp"))
    return g.select("season", "position", "player_id", "first_seen", F.row_number().over(Window.partitionBy("season", "position").orderBy("adp", "player_id")).alias("consensus"))


@query(
    "value_ledger",
    f"""WITH b AS ({_BEST}), s AS (SELECT season, player_id, least(floor(row_number() OVER (PARTITION BY season ORDER BY ppr DESC, player_id) / 12), 14) AS slot, ppr FROM b), c AS (SELECT slot, avg(ppr) AS cost FROM s GROUP BY 1), l AS (SELECT s.season, s.player_id, round(s.ppr - c.cost, 2) AS capture FROM s JOIN c USING (slot))
SELECT season, count_if(capture >= 50) AS over50, count_if(capture >= 25) AS over25, arg_max(player_id, (capture, player_id)) AS top_player, max(capture) AS top_capture FROM l GROUP BY 1""",
)
def value_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points above the price of the slot, counted by tier, with the best capture of a season."""
    b = best(spark, sf_dir)
    slot = F.least(F.floor(F.row_number().over(Window.partitionBy("season").orderBy(F.col("ppr").desc(), "player_id")) / 12), F.lit(14))
    s = b.select("season", "player_id", slot.alias("slot"), "ppr")
    l = s.join(F.broadcast(s.groupBy("slot").agg(F.avg("ppr").alias("cost"))), "slot").select("season", "player_id", F.round(F.col("ppr") - F.col("cost"), 2).alias("capture"))
    return l.groupBy("season").agg(F.count_if(F.col("capture") >= 50).alias("over50"), F.count_if(F.col("capture") >= 25).alias("over25"), F.max_by("player_id", F.struct("capture", "player_id")).alias("top_player"), F.max("capture").alias("top_capture"))


@query("staff_validation", r"SELECT doc_id, lower(regexp_replace(trim(player_name), '\s+', ' ', 'g')) AS person, contains(lower(text), lower(regexp_replace(trim(player_name), '\s+', ' ', 'g'))) AS named FROM documents WHERE player_name IS NOT NULL AND regexp_matches(player_name, '^[ -~]+$')")
def staff_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lower case with single blanks, and whether the text says them."""
    d = table(spark, sf_dir, "documents").where(F.col("player_name").rlike(r"^[ -~]+\z"))
    name = coach_name(F.col("player_name"))
    return d.select("doc_id", name.alias("person"), F.contains(F.lower("text"), name).alias("named"))


@query("staff_validation_all")
def staff_validation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``staff_validation`` over every name that is not null, in any script."""
    d = table(spark, sf_dir, "documents").where(F.col("player_name").isNotNull())
    name = tx.plain(F.col("player_name"))
    return d.select("doc_id", name.alias("person"), F.contains(F.lower("text"), name).alias("named"))
