"""Matched pairs, panels and guarded sources."""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.plans.extras import _BEST, best
from pointgate.plans.registry import query
from pointgate.session import table
from pointgate.sources import guarded
from pointgate.sources.files import scratch, write_jsonl


def seeded_pairs(rows: pd.DataFrame, seed: str, tolerance: float) -> list[tuple]:
    """Disjoint pairs (a, b) of one group: in seeded order everyone takes the first free one after it whose value is near enough."""
    order = sorted(zip(rows["id"], rows["v"], rows["out"]), key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    used: set = set()
    out = []
    for i, (a, va, oa) in enumerate(order):
        if a in used:
            continue
        for b, vb, ob in order[i + 1 :]:
            if b not in used and abs(va - vb) <= tolerance * max(va, vb):
                used |= {a, b}
                out.append((a, b, int(oa > ob)))
                break
    return out


@query("head_to_head")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-to-head pairs of a season and position within 20 % of each other, seeded and disjoint, at most 300 of a season by a seeded draw.

    A group is one position of one season's league.
    """
    b = best(spark, sf_dir).where((F.col("games") >= 4) & (F.col("ppr") / F.col("games") >= 5))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = seeded_pairs(f.assign(v=f["ppr"] / f["games"], id=f["player_id"], out=f["ppr"]), f"h2h:{key[0]}:{key[1]}", 0.2)
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["season", "position", "a", "b", "outcome"])

    p = b.groupBy("season", "position").applyInPandas(run, "season int, position string, a string, b string, outcome int")
    draw = F.row_number().over(Window.partitionBy("season").orderBy(F.sha2(F.concat_ws(":", F.lit("draw"), "a", "b"), 256), "a", "b"))
    return p.withColumn("_r", draw).where("_r <= 300").drop("_r")


def nearest_free(hits: list[tuple], others: list[tuple]) -> list[tuple]:
    """Every hit (rank, id), in order of rank, with the nearest other that is still free, the smaller id at equal distance."""
    free = sorted(others)
    out = []
    for rank, a in sorted(hits):
        if not free:
            break
        i = bisect.bisect_left(free, (rank, ""))
        near = []
        if i < len(free):
            near.append((free[i][0] - rank, free[i][1], i))
        if i:
            # Of the others of the rank before, the smallest id.
            j = bisect.bisect_left(free, (free[i - 1][0], ""))
            near.append((rank - free[j][0], free[j][1], j))
        distance, b, at = min(near)
        free.pop(at)
        out.append((a, b, distance))
    return out


@query("nearest_pairs")
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players who ended among the first 24 matched to the nearest by last season's rank who did not; nobody twice, no limit of distance."""
    s = best(spark, sf_dir)
    before = s.select((F.col("season") + 1).alias("season"), "player_id", F.col("finish").alias("prior")).groupBy("season", "player_id").agg(F.min("prior").alias("prior"))
    x = s.join(before, ["season", "player_id"]).where(F.col("prior").isNotNull()).withColumn("hit", F.coalesce(F.col("finish") <= 24, F.lit(False)))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        side = lambda hit: list(f.loc[f["hit"] == hit, ["prior", "player_id"]].itertuples(index=False, name=None))
        return pd.DataFrame([(key[0], key[1], *r) for r in nearest_free(side(True), side(False))], columns=["season", "position", "a", "b", "distance"])

    return x.groupBy("season", "position").applyInPandas(run, "season int, position string, a string, b string, distance int")


@query(
    "answer_files",
    """WITH a AS (SELECT season, preset, player_id AS question_id, CASE WHEN adp > 150 THEN 1.5 ELSE round(1 / (1 + adp / 20), 4) END AS p, row_number() OVER (PARTITION BY season, preset, player_id ORDER BY adp NULLS LAST, name NULLS LAST, team NULLS LAST, times_drafted NULLS LAST) AS seq FROM draftbench WHERE adp IS NOT NULL AND player_id IS NOT NULL AND season IS NOT NULL AND preset IS NOT NULL),
k AS (SELECT season, player_id AS question_id FROM draftbench WHERE nflverse_id IS NOT NULL AND player_id IS NOT NULL AND season IS NOT NULL GROUP BY 1, 2), x AS (SELECT a.*, k.question_id IS NOT NULL AS known FROM a LEFT JOIN k ON k.season = a.season AND k.question_id = a.question_id)
SELECT season, preset, count(*) AS answers, count_if(NOT known) AS unknown, count_if(known AND p > 1) AS out_of_range, count_if(known AND p <= 1 AND seq > 1) AS duplicates, count_if(known AND p <= 1 AND seq = 1) AS kept FROM x GROUP BY 1, 2""",
)
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in files named by season and preset, read back: unknown, repeated and impossible ones are counted, the first counts."""
    d = table(spark, sf_dir, "draftbench").where(F.col("adp").isNotNull() & F.col("player_id").isNotNull() & F.col("season").isNotNull() & F.col("preset").isNotNull())
    p = F.when(F.col("adp") > 150, 1.5).otherwise(F.round(1 / (1 + F.col("adp") / 20), 4))
    order = Window.partitionBy("season", "preset", "player_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("adp", "name", "team", "times_drafted")])
    a = d.select(F.concat_ws("_", F.lit("answers"), "season", "preset").alias("file"), F.col("player_id").alias("question_id"), p.alias("p"), F.row_number().over(order).alias("seq"))
    folder = scratch(spark, "answers")
    a.repartition("file").write.partitionBy("file").json(folder)
    key = d.where(F.col("nflverse_id").isNotNull()).select("season", F.col("player_id").alias("question_id")).distinct()
    x = guarded.answers(spark, folder, r"answers_(\d{4})_([a-z_]+)").join(key.withColumn("known", F.lit(True)), ["season", "question_id"], "left")
    known, fine = F.coalesce("known", F.lit(False)), F.col("p").between(0, 1)
    return x.groupBy("season", "preset").agg(
        F.count("*").alias("answers"), F.count_if(~known).alias("unknown"), F.count_if(known & ~fine).alias("out_of_range"), F.count_if(known & fine & (F.col("seq") > 1)).alias("duplicates"), F.count_if(known & fine & (F.col("seq") == 1)).alias("kept"),
    )


@query("json_corpus", "SELECT year(make_timestamp(published_ms * 1000))::INTEGER AS year, count(*) AS docs, count(text) AS texts FROM documents WHERE published_ms IS NOT NULL GROUP BY 1")
def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated tree of JSON files with broken lines between, read recursively: broken lines are skipped, the year comes from the path."""
    d = table(spark, sf_dir, "documents").where(F.col("published_ms").isNotNull()).select("doc_id", "text", "published_ms", F.year(F.timestamp_millis("published_ms")).alias("year"))
    folder = scratch(spark, "corpus")
    good = d.select("year", F.to_json(F.struct("doc_id", "text", "published_ms")).alias("value"))
    broken = d.select("year").distinct().select("year", F.lit('{"doc_id": 1, "text": "cut of').alias("value"))
    good.unionAll(broken).write.partitionBy("year").text(folder)
    x = guarded.json_tree(spark, folder, "doc_id long, text string, published_ms long")
    return x.groupBy(F.regexp_extract("_path", r"year=(\d{4})", 1).cast("int").alias("year")).agg(F.count("*").alias("docs"), F.count("text").alias("texts"))


@query(
    "row_contract",
    """SELECT CASE WHEN item_id IS NULL THEN 'no id' WHEN coalesce(text, '') = '' THEN 'no text' WHEN coalesce(split_name, '') NOT IN ('dev', 'test', 'development', 'validation') THEN 'bad split' WHEN season NOT BETWEEN 2000 AND 2100 OR season IS NULL THEN 'bad season' ELSE 'good' END AS verdict, count(*) AS n FROM eval_items GROUP BY 1""",
)
def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as JSON lines, pinned by a digest, and read back row by row under a contract."""
    folder = scratch(spark, "items")
    write_jsonl(table(spark, sf_dir, "eval_items"), folder)
    schema = "item_id long, split_name string, family string, season int, text string"
    x = guarded.pinned_jsonl(spark, folder, schema, guarded.lines_digest(spark, folder))
    rules = [
        ("no id", F.col("item_id").isNotNull()), ("no text", F.coalesce("text", F.lit("")) != ""),
        ("bad split", F.coalesce("split_name", F.lit("")).isin("dev", "test", "development", "validation")), ("bad season", F.coalesce(F.col("season").between(2000, 2100), F.lit(False))),
    ]
    return x.groupBy(guarded.first_broken(rules).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "tier_consistency",
    f"""WITH b AS ({_BEST}), d AS (SELECT season, player_id, position, CASE WHEN finish <= 12 THEN 1 ELSE 0 END AS t1, CASE WHEN finish > 12 AND finish <= 24 THEN 1 ELSE 0 END AS t2, CASE WHEN games >= 14 THEN 'early' WHEN games >= 8 THEN 'middle' ELSE 'late' END AS bucket FROM b),
g AS (SELECT season, bucket, position, count(*) AS n, sum(t1) AS t1, sum(t2) AS t2 FROM d GROUP BY 1, 2, 3)
SELECT bucket, position, count(*) AS seasons, sum(t1)::BIGINT AS tier1, sum(t2)::BIGINT AS tier2, round(avg((t1 >= 1)::INT), 6) AS one_or_more, round(avg((t1 >= 2)::INT), 6) AS two_or_more FROM g GROUP BY 1, 2""",
)
def tier_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tiers by bucket and position, and the share of seasons with one, and with two or more, of the first."""
    one = lambda c: c.cast("int")
    finish = F.col("finish")
    d = best(spark, sf_dir).select("season", "position", F.when(F.col("games") >= 14, "early").when(F.col("games") >= 8, "middle").otherwise("late").alias("bucket"), F.when(finish <= 12, 1).otherwise(0).alias("t1"), F.when((finish > 12) & (finish <= 24), 1).otherwise(0).alias("t2"))
    g = d.groupBy("season", "bucket", "position").agg(F.sum("t1").alias("t1"), F.sum("t2").alias("t2"))
    return g.groupBy("bucket", "position").agg(F.count("*").alias("seasons"), F.sum("t1").alias("tier1"), F.sum("t2").alias("tier2"), F.round(F.avg(one(F.col("t1") >= 1)), 6).alias("one_or_more"), F.round(F.avg(one(F.col("t1") >= 2)), 6).alias("two_or_more"))


_CLAIMS = "SELECT lang, source, position, strpos(lower(coalesce(text, '')), 'sore') > 0 AS claimed, coalesce(n_chars, 0) > 400 AS hit FROM documents"


@query(
    "claim_cells",
    f"""WITH d AS ({_CLAIMS}), b AS (SELECT position, avg(hit::INT) AS base FROM d GROUP BY 1), x AS (SELECT d.*, b.base FROM d JOIN b ON b.position IS NOT DISTINCT FROM d.position),
g AS (SELECT source, lang, grouping(source) AS gs, grouping(lang) AS gl, count_if(claimed)::BIGINT AS n_c, count_if(claimed AND hit)::BIGINT AS k_c, count_if(NOT claimed)::BIGINT AS n_u, count_if(NOT claimed AND hit)::BIGINT AS k_u, sum(CASE WHEN claimed THEN base END) AS expected FROM x GROUP BY GROUPING SETS ((source, lang), (source), (lang), ()))
SELECT CASE WHEN gs = 1 THEN 'all' ELSE coalesce(source, 'none') END AS source, CASE WHEN gl = 1 THEN 'all' ELSE coalesce(lang, 'none') END AS band, n_c, k_c, n_u, k_u, round(expected, 4) AS expected, round((k_c / nullif(n_c, 0)) / nullif(k_u / nullif(n_u, 0), 0), 5) AS lift FROM g""",
)
def claim_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed against unclaimed at every grain (source and band, each alone, all), with the hits that the mix of positions lets expect."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "position", F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("sore")).alias("claimed"), (F.coalesce("n_chars", F.lit(0)) > 400).alias("hit"))
    b = d.groupBy(F.col("position").alias("_p")).agg(F.avg(F.col("hit").cast("int")).alias("base"))
    x = d.join(F.broadcast(b), F.col("position").eqNullSafe(F.col("_p")))
    c, h = F.col("claimed"), F.col("hit")
    g = x.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(
        F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"), F.count_if(c).alias("n_c"), F.count_if(c & h).alias("k_c"), F.count_if(~c).alias("n_u"), F.count_if(~c & h).alias("k_u"), F.sum(F.when(c, F.col("base"))).alias("expected")
    )
    name = lambda flag, col: F.when(F.col(flag) == 1, "all").otherwise(F.coalesce(col, F.lit("none")))
    lift = F.try_divide(F.try_divide("k_c", "n_c"), F.try_divide("k_u", "n_u"))
    return g.select(name("gs", "source").alias("source"), name("gl", "lang").alias("band"), "n_c", "k_c", "n_u", "k_u", F.round("expected", 4).alias("expected"), F.round(lift, 5).alias("lift"))


@query(
    "balanced_panel",
    """WITH c AS (SELECT DISTINCT season, preset, player_id FROM draftbench WHERE season IS NOT NULL AND preset IS NOT NULL AND player_id IS NOT NULL), h AS (SELECT *, sha256('panel:' || season || ':' || preset || ':' || player_id) AS k FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY k, preset, player_id) AS n FROM h),
x AS (SELECT *, row_number() OVER (PARTITION BY n > 4 ORDER BY k, season, preset, player_id) AS e FROM r)
SELECT season, preset, player_id, CASE WHEN n <= 4 THEN 'base' ELSE 'extra' END AS part FROM x WHERE n <= 4 OR e <= 2""",
)
def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of each season in seeded order, and two more of all the others."""
    c = table(spark, sf_dir, "draftbench").where(F.col("season").isNotNull() & F.col("preset").isNotNull() & F.col("player_id").isNotNull()).select("season", "preset", "player_id").distinct()
    h = c.withColumn("k", F.sha2(F.concat_ws(":", F.lit("panel"), F.col("season").cast("string"), "preset", F.col("player_id").cast("string")), 256))
    r = h.withColumn("n", F.row_number().over(Window.partitionBy("season").orderBy("k", "preset", "player_id")))
    base = r.where("n <= 4").select("season", "preset", "player_id", F.lit("base").alias("part"))
    extra = r.where("n > 4").orderBy("k", "season", "preset", "player_id").limit(2).select("season", "preset", "player_id", F.lit("extra").alias("part"))
    return base.unionAll(extra)


@query(
    "pairs_by_schema",
    """WITH t AS (SELECT DISTINCT t11_subtype AS kind, source_trace_id AS pair FROM t11_targeted_v1 WHERE source_trace_id IS NOT NULL AND t11_subtype IS NOT NULL), p AS (SELECT kind, pair, row_number() OVER (PARTITION BY kind ORDER BY sha256('subset:' || kind || ':' || pair), pair) AS n FROM t)
SELECT r.row_id, p.kind, p.pair FROM p JOIN t11_targeted_v1 r ON r.t11_subtype = p.kind AND r.source_trace_id = p.pair WHERE n <= 10""",
)
def pairs_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pairs of each kind in seeded order, whole: all rows that share the pair."""
    t = table(spark, sf_dir, "t11_targeted_v1").where(F.col("source_trace_id").isNotNull() & F.col("t11_subtype").isNotNull()).select("row_id", F.col("t11_subtype").alias("kind"), F.col("source_trace_id").alias("pair"))
    order = Window.partitionBy("kind").orderBy(F.sha2(F.concat_ws(":", F.lit("subset"), "kind", "pair"), 256), "pair")
    p = t.select("kind", "pair").distinct().withColumn("n", F.row_number().over(order)).where("n <= 10").drop("n")
    return t.join(p, ["kind", "pair"]).select("row_id", "kind", "pair")


@query(
    "best_of_question",
    """WITH x AS (SELECT row_id, question_id, abs(coalesce(round, 8) - 8) AS distance, sha256('best:' || row_id) AS h FROM t11_targeted_v1 WHERE question_id IS NOT NULL)
SELECT question_id, row_id, distance FROM x QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, h) = 1""",
)
def best_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every question the row nearest to the middle of a draft, by hash at equal distance."""
    distance = F.abs(F.coalesce("round", F.lit(8)) - 8)
    x = table(spark, sf_dir, "t11_targeted_v1").where(F.col("question_id").isNotNull()).select("row_id", "question_id", distance.alias("distance"), F.sha2(F.concat(F.lit("best:"), F.col("row_id")), 256).alias("h"))
    return x.groupBy("question_id").agg(F.min(F.struct("distance", "h", "row_id")).alias("x")).select("question_id", "x.row_id", "x.distance")


@query(
    "as_of_dates",
    """SELECT item_id, CASE WHEN family LIKE 'week%' THEN make_date(season, 9, 7) + CAST(7 * (item_id % 17) AS INTEGER) ELSE make_date(season, 9, 1) END AS as_of FROM eval_items WHERE season <= 2023""",
)
def as_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an item must be answered: weekly families on their week's day, all others at the gate of the season; sealed seasons are refused."""
    x = guarded.unsealed(table(spark, sf_dir, "eval_items").where(F.col("season") <= 2023), "season", sealed=[2024, 2025])
    week = F.date_add(F.make_date("season", F.lit(9), F.lit(7)), (7 * (F.col("item_id") % 17)).cast("int"))
    return x.select("item_id", F.when(F.startswith("family", F.lit("week")), week).otherwise(F.make_date("season", F.lit(9), F.lit(1))).alias("as_of"))
