"""Further measures: price curves, eras, resampled correlations, class probabilities, gaps with penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators import metrics as m
from pointgate.plans.labels import _YEARLY, yearly
from pointgate.plans.metrics import _DRAWS, _KNOTS, _LABELLED, labelled
from pointgate.plans.registry import query
from pointgate.session import table


@query(
    "slot_values",
    f"""WITH k AS ({_KNOTS}), m AS (SELECT a.preset, a.slot AS a, b.slot AS b, (SELECT sum(v * n) / sum(n) FROM k c WHERE c.preset = a.preset AND c.slot BETWEEN a.slot AND b.slot) AS mean FROM k a JOIN k b ON a.preset = b.preset AND a.slot <= b.slot),
f AS (SELECT i.preset, i.slot, m.a, max(mean) AS mx FROM k i JOIN m ON m.preset = i.preset AND m.a <= i.slot AND m.b >= i.slot GROUP BY 1, 2, 3), x AS (SELECT preset, slot, min(mx) AS fit FROM f GROUP BY 1, 2),
g AS (SELECT preset, CAST(s AS INTEGER) AS slot FROM (SELECT DISTINCT preset FROM k), range(0, 25) r(s))
SELECT preset, slot, CASE WHEN fit >= 0 THEN round(fit, 2) WHEN fit < 0 THEN 0 END AS price, carried FROM (SELECT g.preset, g.slot, last_value(fit IGNORE NULLS) OVER (PARTITION BY g.preset ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fit, x.fit IS NULL AS carried FROM g LEFT JOIN x ON x.preset = g.preset AND x.slot = g.slot)""",
)
def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of every slot of every format over all seasons: the isotonic fit, carried forward over slots without players, not below 0; null before the first player."""
    d = table(spark, sf_dir, "draftbench").where(F.nanvl("adp", F.lit(None)).isNotNull() & F.col("prev_points").isNotNull())
    k = d.groupBy("preset", F.least(F.floor(F.col("adp") / 10), F.lit(17)).cast("int").alias("slot")).agg(F.avg("prev_points").alias("v"), F.count("*").alias("n"))
    fit = m.isotonic_decreasing(k, by=["preset"], x="slot", value="v", weight="n")
    every = k.select("preset").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24))))
    x = every.join(fit, ["preset", "slot"], "left")
    known = F.last("fit", ignorenulls=True).over(Window.partitionBy("preset").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("preset", "slot", F.greatest(F.round(known, 2), F.when(known.isNotNull(), 0.0)).alias("price"), F.col("fit").isNull().alias("carried"))


_ERA_CELLS = f"SELECT CASE WHEN season < 1995 THEN 'early' ELSE 'late' END AS era, season, count(*) AS n, sum((p - y) * (p - y)) AS s FROM ({_LABELLED}) GROUP BY 1, 2"


@query(
    "era_intervals",
    f"""WITH e AS ({_ERA_CELLS}), a AS (SELECT * FROM e UNION ALL SELECT 'all', season, n, s FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY season) - 1 AS pos, count(*) OVER (PARTITION BY era) AS k FROM a),
d AS (SELECT era, rep, pos, CAST('0x' || substr(md5('era-' || era || ':' || rep || ':' || pos), 1, 8) AS BIGINT) % k AS pick FROM c, range(1, 401) r(rep)),
r AS (SELECT d.era, rep, sum(c.s) / sum(c.n) AS v FROM d JOIN c ON c.era = d.era AND c.pos = d.pick GROUP BY 1, 2), q AS (SELECT era, list_sort(list(v)) AS vs FROM r GROUP BY 1)
SELECT q.era, round((SELECT sum(s) / sum(n) FROM c WHERE c.era = q.era), 6) AS brier, round(vs[CAST(floor(0.025::DOUBLE * 399) AS INTEGER) + 1], 6) AS low, round(vs[CAST(floor(0.975::DOUBLE * 399) AS INTEGER) + 1], 6) AS high FROM q""",
)
def era_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of all seasons and of each era, each with an interval of its own resampling of seasons."""
    e = labelled(spark, sf_dir).groupBy(F.when(F.col("season") < 1995, "early").otherwise("late").alias("era"), "season").agg(F.count("*").alias("n"), F.sum((F.col("p") - F.col("y")) ** 2).alias("s"))
    a = e.unionByName(e.withColumn("era", F.lit("all")))
    c = a.withColumn("pos", F.row_number().over(Window.partitionBy("era").orderBy("season")) - 1).withColumn("k", F.count("*").over(Window.partitionBy("era")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.concat(F.lit("era-"), "era"), F.col("rep").cast("string"), F.col("pos").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    d = c.select("era", "pos", "k", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("rep")).select("era", "rep", (draw % F.col("k")).alias("pick"))
    r = d.join(F.broadcast(c.select("era", F.col("pos").cast("long").alias("pick"), "n", "s")), ["era", "pick"]).groupBy("era", "rep").agg((F.sum("s") / F.sum("n")).alias("v"))
    q = r.groupBy("era").agg(F.round(m.index_percentile(F.col("v"), 0.025), 6).alias("low"), F.round(m.index_percentile(F.col("v"), 0.975), 6).alias("high"))
    return c.groupBy("era").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("brier")).join(q, "era")


@query(
    "corr_bootstrap",
    f"""WITH g AS (SELECT year(l_shipdate) AS season, count(*) AS n, sum(l_quantity) AS sx, sum(l_discount) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_discount * l_discount) AS syy, sum(l_quantity * l_discount) AS sxy FROM lineitem GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY season) - 1 AS pos FROM g), d AS ({_DRAWS.format(seed='corr', reps=401)}),
r AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN c ON c.pos = d.pick GROUP BY 1), v AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM r WHERE n >= 3 AND (n * sxx - sx * sx) > 0 AND (n * syy - sy * sy) > 0), o AS (SELECT list_sort(list(r)) AS vs FROM v)
SELECT round((SELECT corr(l_quantity, l_discount) FROM lineitem), 5) AS r, len(vs) AS reps, round(vs[CAST(floor(0.025::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 5) AS low, round(vs[CAST(floor(0.975::DOUBLE * (len(vs) - 1)) AS INTEGER) + 1], 5) AS high FROM o""",
)
def corr_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlation and its interval: seasons are resampled through their sums and products, rows never."""
    x, y = F.col("l_quantity"), F.col("l_discount")
    l = table(spark, sf_dir, "lineitem")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    c = l.groupBy(F.year("l_shipdate").alias("season")).agg(*[f.alias(k) for k, f in sums.items()]).withColumn("pos", F.row_number().over(Window.orderBy("season")) - 1)  # one row a season
    d = m.resample_draws(c.select("pos"), 400, "corr").join(F.broadcast(c.withColumn("pick", F.col("pos").cast("long")).drop("pos")), "pick")
    r = d.groupBy("rep").agg(*[F.sum(k).alias(k) for k in sums])
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    v = r.where((F.col("n") >= 3) & (vx > 0) & (vy > 0)).select(((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).alias("v"))
    whole = l.agg(F.round(F.corr(x, y), 5).alias("r"))
    q = v.agg(F.count("*").alias("reps"), F.round(m.index_percentile(F.col("v"), 0.025), 5).alias("low"), F.round(m.index_percentile(F.col("v"), 0.975), 5).alias("high"))
    return whole.crossJoin(F.broadcast(q))


_PROBS = """SELECT o_orderkey, o_orderstatus AS y, a / (a + b + 0.5) AS pf, b / (a + b + 0.5) AS po, 0.5 / (a + b + 0.5) AS pp FROM (SELECT o_orderkey, o_orderstatus, 1 + (o_orderkey % 7) AS a, 1 + o_totalprice / 100000.0 AS b FROM orders)"""


@query(
    "class_probabilities",
    f"""WITH p AS ({_PROBS}), x AS (SELECT *, CASE y WHEN 'F' THEN pf WHEN 'O' THEN po ELSE pp END AS py, CASE WHEN pf >= po AND pf >= pp THEN 'F' WHEN po >= pp THEN 'O' ELSE 'P' END AS said, greatest(pf, po, pp) AS top FROM p),
b AS (SELECT least(floor(top * 10), 9) AS bin, count(*) AS n, avg(top) AS conf, avg(CASE WHEN said = y THEN 1.0 ELSE 0.0 END) AS acc FROM x GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN said = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-ln(greatest(py, 1e-15))), 6) AS log_loss, round(avg((pf - (y = 'F')::INT) ^ 2 + (po - (y = 'O')::INT) ^ 2 + (pp - (y NOT IN ('F', 'O'))::INT) ^ 2), 6) AS brier, (SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) FROM b) AS ece,
  round(avg((said = 'P')::INT), 6) AS p_rate, round(avg(CASE WHEN y = 'P' THEN (said = 'P')::INT END), 6) AS p_recall, round(avg(CASE WHEN said = 'F' THEN (y = 'F')::INT END), 6) AS f_precision, round(avg((said = 'F' AND y = 'O')::INT), 6) AS f_for_o, round(avg((said = 'O' AND y = 'F')::INT), 6) AS o_for_f, round(avg((top < 0.5)::INT), 6) AS unsure, round(avg(CASE WHEN top < 0.5 THEN (said = y)::INT END), 6) AS unsure_right FROM x""",
)
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, log loss, Brier score, calibration error and seven rates of a forecast over three classes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("y"), (1 + F.col("o_orderkey") % 7).cast("double").alias("a"), (1 + F.col("o_totalprice") / 100000.0).alias("b"))
    whole = F.col("a") + F.col("b") + 0.5
    x = o.select("y", (F.col("a") / whole).alias("pf"), (F.col("b") / whole).alias("po"), (0.5 / whole).alias("pp"))
    pf, po, pp, y = F.col("pf"), F.col("po"), F.col("pp"), F.col("y")
    x = x.withColumns({"py": F.when(y == "F", pf).when(y == "O", po).otherwise(pp), "said": F.when((pf >= po) & (pf >= pp), "F").when(po >= pp, "O").otherwise("P"), "top": F.greatest(pf, po, pp)})
    said, top = F.col("said"), F.col("top")
    yes = lambda c: c.cast("int").cast("double")
    bins = x.groupBy(F.least(F.floor(top * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("top").alias("conf"), F.avg(yes(said == y)).alias("acc"))
    ece = bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))
    off = lambda p, c: (p - yes(c)) ** 2
    got = x.agg(
        F.count("*").alias("n"), F.round(F.avg(yes(said == y)), 6).alias("accuracy"), F.round(F.avg(-F.ln(F.greatest("py", F.lit(m.EPS)))), 6).alias("log_loss"), F.round(F.avg(off(pf, y == "F") + off(po, y == "O") + off(pp, ~y.isin("F", "O"))), 6).alias("brier"),
        F.round(F.avg(yes(said == "P")), 6).alias("p_rate"), F.round(F.avg(F.when(y == "P", yes(said == "P"))), 6).alias("p_recall"), F.round(F.avg(F.when(said == "F", yes(y == "F"))), 6).alias("f_precision"), F.round(F.avg(yes((said == "F") & (y == "O"))), 6).alias("f_for_o"),
        F.round(F.avg(yes((said == "O") & (y == "F"))), 6).alias("o_for_f"), F.round(F.avg(yes(top < 0.5)), 6).alias("unsure"), F.round(F.avg(F.when(top < 0.5, yes(said == y))), 6).alias("unsure_right"),
    )
    return got.crossJoin(F.broadcast(ece))


@query(
    "policy_calibration",
    """WITH l AS (SELECT l_returnflag AS family, least(greatest(l_quantity / 60.0 + l_discount, 0.02), 0.98) AS p, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_extendedprice AS e FROM lineitem), b AS (SELECT family, least(CAST(floor(p * 5) AS INTEGER), 4) AS bin, p, y, e / 1000.0 * (y - p) AS reward FROM l),
c AS (SELECT family, round(corr(p, reward), 5) AS p_reward FROM b GROUP BY 1)
SELECT b.family, bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS freq, any_value(p_reward) AS p_reward FROM b JOIN c ON c.family = b.family GROUP BY 1, 2""",
)
def policy_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bins of calibration per family, and how the probability goes with the reward."""
    p = F.least(F.greatest(F.col("l_quantity") / 60.0 + F.col("l_discount"), F.lit(0.02)), F.lit(0.98))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), p.alias("p"), (F.col("l_linestatus") == "F").cast("int").alias("y"), "l_extendedprice")
    b = l.select("family", "p", "y", F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("int").alias("bin"), (F.col("l_extendedprice") / 1000.0 * (F.col("y") - F.col("p"))).alias("reward"))
    c = b.groupBy("family").agg(F.round(F.corr("p", "reward"), 5).alias("p_reward"))
    g = b.groupBy("family", "bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("freq"))
    return g.join(c, "family")


@query(
    "accuracy_gap",
    _YEARLY
    + """, s AS (SELECT y.year, y.custkey, y.rank AS actual, a.rank AS prior, a.total AS prior_total FROM y LEFT JOIN y a ON a.custkey = y.custkey AND a.year = y.year - 1 WHERE y.segment = 'BUILDING' AND y.rank <= 60),
g AS (SELECT year, max(prior) FILTER (WHERE prior <= 80) AS deepest, count(*) AS pool FROM s GROUP BY 1), c AS (SELECT year, rank, total FROM y WHERE segment = 'BUILDING'), m AS (SELECT year, max(rank) AS last_rank FROM c GROUP BY 1),
x AS (SELECT s.*, CASE WHEN prior IS NULL OR prior > 80 THEN coalesce(deepest, 0) + 1 ELSE prior END AS ranked, prior IS NULL OR prior > 80 AS unranked FROM s JOIN g USING (year)), v AS (SELECT x.*, e.total AS expected, r.total AS reached FROM x JOIN m USING (year) JOIN c e ON e.year = x.year AND e.rank = least(ranked, last_rank) JOIN c r ON r.year = x.year AND r.rank = least(actual, last_rank))
SELECT year, count(*) AS n, count_if(unranked) AS unranked, round(sum(abs(expected - reached) * CASE WHEN actual <= 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 2) AS gap, round(sum(CASE WHEN unranked AND actual <= 24 THEN 1000.0::DOUBLE ELSE 0 END), 1) AS penalty FROM v GROUP BY 1""",
)
def accuracy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap between expected and reached totals over a pool.

    Ranks become totals by the curve of the year, clamped at its last rank.  Whoever was not ranked
    stands one past the deepest rank of the pool, and costs a penalty when ending among the best.
    """
    y = yearly(spark, sf_dir).where("segment = 'BUILDING'")
    # A prior rank counts within the segment of then, so it is taken over all segments.
    all_ = yearly(spark, sf_dir).select((F.col("year") + 1).alias("year"), "custkey", F.col("rank").alias("prior"))
    s = y.where("rank <= 60").select("year", "custkey", F.col("rank").alias("actual")).join(all_, ["year", "custkey"], "left")
    ranked = F.coalesce(F.col("prior") <= 80, F.lit(False))
    deepest = s.groupBy("year").agg(F.max(F.when(ranked, F.col("prior"))).alias("deepest"))
    curve = y.select("year", "rank", "total")
    last = y.groupBy("year").agg(F.max("rank").alias("last_rank"))
    x = s.join(deepest, "year").join(last, "year").select("year", "actual", (~ranked).alias("unranked"), F.least(F.when(ranked, F.col("prior")).otherwise(F.coalesce("deepest", F.lit(0)) + 1), "last_rank").alias("at"), F.least("actual", "last_rank").alias("end"))
    v = x.join(curve.toDF("year", "at", "expected"), ["year", "at"]).join(curve.toDF("year", "end", "reached"), ["year", "end"])
    weight = F.when(F.col("actual") <= 12, 1.0).otherwise(0.5)
    return v.groupBy("year").agg(
        F.count("*").alias("n"), F.count_if("unranked").alias("unranked"), F.round(F.sum(F.abs(F.col("expected") - F.col("reached")) * weight), 2).alias("gap"),
        F.round(F.sum(F.when(F.col("unranked") & (F.col("actual") <= 24), 1000.0).otherwise(0.0)), 1).alias("penalty"),
    )


@query("first_team", "SELECT season, gsis_id, arg_min(club_code, (week, loaded_at, depth_id)) AS team, min(week) AS week FROM depth_weekly WHERE gsis_id IS NOT NULL AND club_code IS NOT NULL AND week IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1, 2")
def first_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team of the earliest week of each player and season."""
    d = table(spark, sf_dir, "depth_weekly").where(F.col("gsis_id").isNotNull() & F.col("club_code").isNotNull() & F.col("week").isNotNull() & F.col("loaded_at").isNotNull())
    return d.groupBy("season", "gsis_id").agg(F.min_by("club_code", F.struct("week", "loaded_at", "depth_id")).alias("team"), F.min("week").alias("week"))


@query(
    "uncertain_turns",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, abs(value - 50) AS sure FROM events WHERE value IS NOT NULL)
SELECT user_id, day, arg_min(event_id, (sure, event_id)) AS most_uncertain, arg_max(event_id, (sure, -event_id)) AS least_uncertain, count(*) AS n FROM e GROUP BY 1, 2""",
)
def uncertain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of highest and of lowest uncertainty of every episode (a user's day), the earlier one at ties."""
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("user_id", F.to_date("ts").alias("day"), "event_id", F.abs(F.col("value") - 50).alias("sure"))
    return e.groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("sure", "event_id")).alias("most_uncertain"), F.max_by("event_id", F.struct("sure", -F.col("event_id"))).alias("least_uncertain"), F.count("*").alias("n"))


@query(
    "early_stop",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e), w AS (SELECT user_id, i, sum(bad) OVER (PARTITION BY user_id ORDER BY i) AS bads FROM o WHERE i <= 20),
k AS (SELECT user_id, min(i) FILTER (WHERE i >= 5 AND bads - i * 0.2::DOUBLE > 1.645::DOUBLE * sqrt(i * 0.2 * 0.8::DOUBLE)) AS stopped, max(i) AS seen FROM w GROUP BY 1)
SELECT user_id, seen, stopped, CASE WHEN stopped IS NOT NULL THEN 'stop' WHEN seen < 20 THEN 'open' ELSE 'go on' END AS verdict FROM k""",
)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential test on the first 20 outcomes of a user: stop once errors exceed a fifth beyond chance, from the fifth on."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").cast("int").alias("bad"), F.row_number().over(order).alias("i"), F.sum((F.col("event_type") == "error").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bads")).where("i <= 20")
    beyond = (F.col("i") >= 5) & (F.col("bads") - F.col("i") * 0.2 > 1.645 * F.sqrt(F.col("i") * 0.2 * 0.8))
    k = e.groupBy("user_id").agg(F.max("i").alias("seen"), F.min(F.when(beyond, F.col("i"))).alias("stopped"))
    return k.select("user_id", "seen", "stopped", F.when(F.col("stopped").isNotNull(), "stop").when(F.col("seen") < 20, "open").otherwise("go on").alias("verdict"))


@query(
    "encode_missing",
    "SELECT DISTINCT ON (packet_id) packet_id, coalesce(tgt_games_s1::DOUBLE, 'nan'::DOUBLE) AS tgt, (tgt_games_s1 IS NULL)::INT AS tgt_missing, coalesce(age_at_sept1::DOUBLE, 'nan'::DOUBLE) AS age, (age_at_sept1 IS NULL)::INT AS age_missing, coalesce(draft_pick::DOUBLE, 'nan'::DOUBLE) AS pick, (draft_pick IS NULL)::INT AS pick_missing FROM packet_features WHERE packet_id IS NOT NULL ORDER BY packet_id, ingested_at DESC NULLS LAST",
)
def encode_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field as a number with NaN for what is missing, and an indicator beside it."""
    fields = {"tgt": "tgt_games_s1", "age": "age_at_sept1", "pick": "draft_pick"}
    p = table(spark, sf_dir, "packet_features").where(F.col("packet_id").isNotNull())
    one = p.groupBy("packet_id").agg(F.max_by(F.struct(*fields.values()), F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("x")).select("packet_id", "x.*")
    cols = [c for n, f in fields.items() for c in (F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(n), F.col(f).isNull().cast("int").alias(f"{n}_missing"))]
    return one.select("packet_id", *cols)


@query(
    "masked_news",
    "SELECT doc_id, 'Player-' || substr(sha256('mask:' || player_id), 1, 8) AS who, CASE WHEN coalesce(player_name, '') = '' THEN text ELSE replace(text, player_name, 'Player-' || substr(sha256('mask:' || player_id), 1, 8)) END AS text, date_diff('day', DATE '2024-09-01', make_timestamp(published_ms * 1000)::DATE) AS day FROM documents WHERE player_id IS NOT NULL AND text IS NOT NULL AND published_ms IS NOT NULL",
)
def masked_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News without names, ids or dates: the name replaced by a stable mask, the time as days from a gate."""
    d = table(spark, sf_dir, "documents").where(F.col("player_id").isNotNull() & F.col("text").isNotNull() & F.col("published_ms").isNotNull())
    who = F.concat(F.lit("Player-"), F.left(F.sha2(F.concat(F.lit("mask:"), "player_id"), 256), F.lit(8)))
    text = F.when(F.coalesce("player_name", F.lit("")) == "", F.col("text")).otherwise(F.replace("text", F.col("player_name"), who))
    return d.select("doc_id", who.alias("who"), text.alias("text"), F.datediff(F.to_date(F.timestamp_millis("published_ms")), F.lit("2024-09-01").cast("date")).alias("day"))
