"""Drafts, championships, canaries, counterfactuals and stateful episodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators import simulation as sim
from pointgate.plans.registry import query
from pointgate.plans.windows import _ROLES, _WEEKLY, lineup_hindsight
from pointgate.session import table


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players of each season's and preset's board, one row each."""
    d = table(spark, sf_dir, "draftbench").where(F.col("adp").isNotNull())
    b = d.groupBy("season", "preset", "player_id").agg(F.min(F.struct("adp", "stdev", "position", "prev_points")).alias("x"))
    return b.select("season", "preset", "player_id", "x.*")


def grid(spark: SparkSession, sf_dir: str, seeds: int, policies: list[str], supervisors: tuple[str, ...] = ("none",)) -> DataFrame:
    """Every season and preset with every slot, seed, policy and supervisor."""
    x = table(spark, sf_dir, "draftbench").where(F.col("season").isNotNull() & F.col("preset").isNotNull()).select("season", "preset").distinct()
    many = lambda values: F.explode(F.array(*map(F.lit, values)))
    x = x.withColumn("slot", many(range(1, sim.Rules().teams + 1))).withColumn("seed", many(range(seeds)))
    return x.withColumn("policy", many(policies)).withColumn("supervisor", many(supervisors))


def all_picks(cell: tuple, board: pd.DataFrame) -> list[tuple]:
    return sim.play(board, **sim.arguments(cell)).picks


@query("draft_sim")
def draft_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick of the grid of seasons, presets, slots, seeds and policies."""
    return sim.each_draft(grid(spark, sf_dir, 1, list(sim.POLICIES)), boards(spark, sf_dir), "pick int, team int, player_id string", all_picks)


def draft_result(cell: tuple, board: pd.DataFrame) -> list[tuple]:
    """What a finished draft is worth: points of the best line-up, gaps, positions, look-ups."""
    d = sim.play(board, **sim.arguments(cell))
    mine = [d.index[p] for _, t, p in d.picks if t == d.slot]
    used: set[int] = set()
    best = lambda places, n: used.update(sorted((i for i in mine if d.names[d.position[i]] in places and i not in used), key=lambda i: -d.points[i])[:n])
    for p, n in d.rules.starters.items():
        best((p,), n)
    best(d.rules.flex, d.rules.flex_places)
    n = dict(zip(d.names, d.counts[d.slot - 1].tolist()))
    return [(float(round(sum(d.points[i] for i in used), 2)), int(d.gaps(d.counts[d.slot - 1])), len(mine), *[n.get(p, 0) for p in ("QB", "RB", "WR", "TE")], d.total_lookups, d.capped)]


@query("draft_benchmark")
def draft_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-up of each policy against the control that shares season, slot, seed and opponents."""
    schema = "points double, gaps int, picks int, qb int, rb int, wr int, te int, lookups int, capped int"
    t = sim.each_draft(grid(spark, sf_dir, 1, list(sim.POLICIES)), boards(spark, sf_dir), schema, draft_result)
    control = t.where("policy = 'autopick'").select("season", "preset", "slot", "seed", F.col("points").alias("control"))
    return t.join(control, ["season", "preset", "slot", "seed"]).withColumn("delta", F.round(F.col("points") - F.col("control"), 2))


@query("draft_panel")
def draft_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms (policy and supervisor) over a matched panel: mean, deviation, wins against the control, share of full line-ups, 95th percentile by index, look-ups."""
    schema = "points double, gaps int, picks int, qb int, rb int, wr int, te int, lookups int, capped int"
    arms = grid(spark, sf_dir, 1, ["autopick", "greedy"], tuple(sim.SUPERVISORS)).where("policy = 'greedy' or supervisor = 'none'")
    t = sim.each_draft(arms, boards(spark, sf_dir), schema, draft_result)
    control = t.where("policy = 'autopick' and supervisor = 'none'").select("season", "preset", "slot", "seed", F.col("points").alias("control"))
    x = t.join(control, ["season", "preset", "slot", "seed"])
    high = F.element_at(F.array_sort(F.collect_list("points")), F.floor(0.95 * (F.count("*") - 1) + 1).cast("int"))
    return x.groupBy("policy", "supervisor").agg(
        F.count("*").alias("n"), F.round(F.avg("points"), 2).alias("mean"), F.round(F.stddev_samp("points"), 2).alias("sd"), F.round(F.avg(F.col("points") - F.col("control")), 2).alias("delta"),
        F.count_if(F.col("points") > F.col("control")).alias("wins"), F.count_if(F.col("points") == F.col("control")).alias("ties"), F.count_if(F.col("points") < F.col("control")).alias("losses"),
        F.round(F.avg((F.col("gaps") == 0).cast("int")), 4).alias("full"), F.round(high, 2).alias("p95"), F.sum("lookups").alias("lookups"),
    )


def replayed(cell: tuple, board: pd.DataFrame) -> list[tuple]:
    args = sim.arguments(cell)
    full = sim.play(board, **args)
    at = {}
    sim.play(board, **args, on_turn=lambda d, seen, action: at.setdefault(d.pick, d.state()))
    stop = sorted(at)[len(at) // 2] if at else 1
    part = sim.play(board, **args, until=stop)
    return [(len(part.picks), part.state() == at.get(stop, part.state()) and full.picks[: len(part.picks)] == part.picks)]


@query("replay_prefix")
def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays of half of each draft, and whether their digest is the one that the full run had there."""
    return sim.each_draft(grid(spark, sf_dir, 1, ["greedy"]), boards(spark, sf_dir), "replayed int, same boolean", replayed)


def traces(cell: tuple, board: pd.DataFrame) -> list[tuple]:
    """Turns of an expert: directly, after a bad third pick of its own, and with a look-up before the pick."""
    out: list[tuple] = []

    def note(kind: str):  # noqa: ANN202
        def on_turn(d: sim.Draft, seen: dict, action: dict) -> None:
            shown = [c["player_id"] for c in seen["candidates"]]
            out.append((kind, d.pick, "tool" if "tool" in action else "pick", str(action.get("pick") or action["args"]["player_id"]), len(seen["roster"]), shown[0] if shown else None, d.state()[:12]))

        return on_turn

    args = sim.arguments(cell)
    sim.play(board, **args, on_turn=note("direct"))
    own = sim.Rules().picks(cell[2])[2]
    bad = board.sort_values(["adp", "player_id"]).iloc[-1]["player_id"]
    sim.play(board, **args, force={own: bad}, on_turn=note("recovery"))
    out = [r for r in out if r[0] == "direct" or r[1] > own]
    start = len(out)
    sim.play(board, **(args | {"supervisor": "look_up_first"}), on_turn=note("tool_pair"))
    tools = {r[1] for r in out[start:] if r[2] == "tool"}
    return out[:start] + [r for r in out[start:] if r[1] in tools]


@query("expert_traces")
def expert_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn of the expert, of three kinds of traces."""
    schema = "kind string, pick int, action string, player_id string, held int, first_shown string, state string"
    return sim.each_draft(grid(spark, sf_dir, 1, ["value"]), boards(spark, sf_dir), schema, traces)


_CHAMP = f"""
WITH w AS ({_WEEKLY}), {_ROLES.format(order='pts DESC, user_id, pos', src='w')}, p AS (SELECT team, week, round(sum(pts), 2) AS points FROM s WHERE role IS NOT NULL GROUP BY 1, 2),
gm AS (SELECT sim, team, week, points, row_number() OVER (PARTITION BY sim, week ORDER BY md5(sim || ':' || week || ':' || team), team) - 1 AS r FROM p, range(200) q(sim) WHERE week < 3),
m AS (SELECT a.sim, a.team, CASE WHEN b.team IS NULL OR a.points > b.points THEN 2 WHEN a.points = b.points THEN 1 ELSE 0 END AS half_wins, a.points FROM gm a LEFT JOIN gm b ON b.sim = a.sim AND b.week = a.week AND b.r // 2 = a.r // 2 AND b.team <> a.team),
t AS (SELECT sim, team, sum(half_wins) AS half_wins, sum(points) AS points FROM m GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY half_wins DESC, round(points, 2) DESC, team) AS seed FROM t),
k AS (SELECT o.sim, o.team, o.seed, coalesce(p3.points, 0) AS half_final, coalesce(p4.points, 0) AS final FROM o LEFT JOIN p p3 ON p3.team = o.team AND p3.week = 3 LEFT JOIN p p4 ON p4.team = o.team AND p4.week = 4 WHERE seed <= 4),
fin AS (SELECT *, row_number() OVER (PARTITION BY sim, CASE WHEN seed IN (1, 4) THEN 0 ELSE 1 END ORDER BY half_final DESC, seed) = 1 AS finalist FROM k), c AS (SELECT sim, arg_max(team, (final, -seed)) AS team FROM fin WHERE finalist GROUP BY 1)
SELECT team, round(count(DISTINCT CASE WHEN seed <= 4 THEN o.sim END) / 200.0, 4) AS playoff, round((SELECT count(*) FROM c WHERE c.team = o.team) / 200.0, 4) AS title FROM o GROUP BY 1
"""


@query("champ_odds", _CHAMP)
def champ_odds(spark: SparkSession, sf_dir: str, sims: int = 200) -> DataFrame:
    """Playoff and title odds: weekly pairings by hash, four seeds, 1 v 4 and 2 v 3, then the final."""
    p = lineup_hindsight(spark, sf_dir).select("team", "week", "points")
    g = p.where("week < 3").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    key = F.md5(F.concat_ws(":", F.col("sim").cast("string"), F.col("week").cast("string"), F.col("team").cast("string")).cast("binary"))
    g = g.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("sim", "week").orderBy(key, "team")) - 1) / 2))
    match = Window.partitionBy("sim", "week", "pair")
    other = F.when(F.count("*").over(match) == 2, F.sum("points").over(match) - F.col("points"))
    best, worst = F.max("points").over(match), F.min("points").over(match)
    won = F.when(other.isNull(), 2).when(best == worst, 1).when(F.col("points") == best, 2).otherwise(0)
    t = g.withColumn("half_wins", won).groupBy("sim", "team").agg(F.sum("half_wins").alias("half_wins"), F.sum("points").alias("points"))
    o = t.withColumn("seed", F.row_number().over(Window.partitionBy("sim").orderBy(F.col("half_wins").desc(), F.round("points", 2).desc(), "team"))).where("seed <= 4")
    late = p.groupBy("team").agg(F.max(F.when(F.col("week") == 3, F.col("points"))).alias("semi"), F.max(F.when(F.col("week") == 4, F.col("points"))).alias("final"))
    k = o.join(late, "team").fillna(0.0, ["semi", "final"])
    half = Window.partitionBy("sim", F.col("seed").isin(1, 4)).orderBy(F.col("semi").desc(), "seed")
    f = k.withColumn("r", F.row_number().over(half)).where("r = 1")
    c = f.groupBy("sim").agg(F.max_by("team", F.struct("final", -F.col("seed"))).alias("team")).groupBy("team").agg(F.count("*").alias("titles"))
    playoff = o.groupBy("team").agg(F.count("*").alias("n"))
    teams = t.select("team").distinct().join(playoff, "team", "left").join(c, "team", "left")
    return teams.select("team", F.round(F.coalesce("n", F.lit(0)) / float(sims), 4).alias("playoff"), F.round(F.coalesce("titles", F.lit(0)) / float(sims), 4).alias("title"))


_PAIRS = """WITH r AS (SELECT season, player_id, position, max(total_ppr) AS ppr, max(games) AS games FROM season_points GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY ppr DESC, player_id) AS k FROM r),
q AS (SELECT *, (k + 1) // 2 AS pair FROM o), z AS (SELECT *, count(*) OVER (PARTITION BY season, position, pair) AS n, sha256(season || ':' || position || ':' || pair) < '8' AS swapped FROM q)
"""


def canary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "season_points").groupBy("season", "player_id", "position").agg(F.max("total_ppr").alias("ppr"), F.max("games").alias("games"))
    q = r.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("season", "position").orderBy(F.col("ppr").desc(), "player_id")) + 1) / 2))
    h = F.sha2(F.concat_ws(":", F.col("season").cast("string"), "position", F.col("pair").cast("string")), 256)
    return q.withColumn("n", F.count("*").over(Window.partitionBy("season", "position", "pair"))).withColumn("swapped", h < "8")


@query("canary_swap", _PAIRS + "SELECT a.season, a.position, a.pair, a.player_id, a.swapped AND a.n = 2 AS swapped, CASE WHEN a.swapped AND a.n = 2 THEN b.player_id ELSE a.player_id END AS packet_owner, CASE WHEN a.swapped AND a.n = 2 THEN b.games ELSE a.games END AS games FROM z a LEFT JOIN z b ON b.season = a.season AND b.position = a.position AND b.pair = a.pair AND b.player_id <> a.player_id")
def canary_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets swapped within pairs of neighbours; the key remembers whose packet it is."""
    z = canary_pairs(spark, sf_dir)
    both = Window.partitionBy("season", "position", "pair").orderBy("player_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.element_at(F.filter(F.collect_list(F.struct("player_id", "games")).over(both), lambda x: x["player_id"] != F.col("player_id")), 1)
    do = F.col("swapped") & (F.col("n") == 2)
    z = z.withColumn("other", F.when(do, other)).withColumn("do", do)
    return z.select("season", "position", "pair", "player_id", F.col("do").alias("swapped"), F.coalesce("other.player_id", "player_id").alias("packet_owner"), F.when(F.col("do"), F.col("other.games")).otherwise(F.col("games")).alias("games"))


@query(
    "canary_scores",
    _PAIRS + ", p AS (SELECT season, position, pair, arg_max(games, k) AS g2, arg_min(games, k) AS g1, bool_or(swapped) AS swapped FROM z WHERE n = 2 GROUP BY 1, 2, 3) SELECT season, CASE WHEN swapped THEN 'swapped' ELSE 'control' END AS arm, count(*) AS pairs, round(avg(CASE WHEN g1 > g2 THEN 1.0 WHEN g1 = g2 THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1, 2",
)
def canary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair accuracy by arm: 1 for the right order, a half for a tie."""
    z = canary_pairs(spark, sf_dir).where("n = 2")
    p = z.groupBy("season", "position", "pair").agg(F.array_sort(F.collect_list(F.struct((-F.col("ppr")).alias("k"), "player_id", "games"))).alias("x"), F.bool_or("swapped").alias("swapped"))
    g1, g2 = F.element_at("x", 1)["games"], F.element_at("x", 2)["games"]
    credit = F.when(g1 > g2, 1.0).when(g1 == g2, 0.5).otherwise(0.0)
    return p.groupBy("season", F.when(F.col("swapped"), "swapped").otherwise("control").alias("arm")).agg(F.count("*").alias("pairs"), F.round(F.avg(credit), 6).alias("accuracy"))


@query(
    "branch_compare",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS act, sum(CASE WHEN event_type = 'error' THEN 0 ELSE value * 1.02 END) AS intervene, count_if(event_type = 'error') AS errors FROM events GROUP BY 1, 2)
SELECT user_id, day, round(intervene - act, 4) AS gain, CASE WHEN errors = 0 THEN 'UNNECESSARY' WHEN intervene - act >= 1 THEN 'HELPFUL' WHEN intervene - act <= -1 THEN 'HARMFUL' ELSE 'UNRESOLVABLE' END AS label FROM e""",
)
def branch_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of an episode from the same events, and the label of the better one."""
    error = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("act"), F.sum(F.when(error, 0.0).otherwise(F.col("value") * 1.02)).alias("intervene"), F.count_if(error).alias("errors"))
    gain = F.col("intervene") - F.col("act")
    label = F.when(F.col("errors") == 0, "UNNECESSARY").when(gain >= 1, "HELPFUL").when(gain <= -1, "HARMFUL").otherwise("UNRESOLVABLE")
    return e.select("user_id", "day", F.round(gain, 4).alias("gain"), label.alias("label"))


@query(
    "episode_state",
    """SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS step,
  least(3, count_if(event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lookups FROM events""",
)
def episode_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over the events of an episode (a user's day) that emits its state at every step.

    The state is a capped counter, which a running window can carry; no group goes to Python.
    """
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    used = F.count_if(F.col("event_type") == "error").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("user_id", "day", "event_id", F.row_number().over(w).alias("step"), F.least(F.lit(3), used).alias("lookups"))


@query(
    "array_feasibility",
    """WITH r AS (SELECT season, team, count_if(position = 'QB') AS qb, count_if(position = 'RB') AS rb, count_if(position = 'WR') AS wr, count_if(position = 'TE') AS te FROM (SELECT DISTINCT season, player_id, position, split_part(team, '/', 1) AS team FROM season_points) GROUP BY 1, 2)
SELECT season, team, greatest(0, 1 - qb) + greatest(0, 2 - rb) + greatest(0, 2 - wr) + greatest(0, 1 - te) AS missing, greatest(0, qb - 1) + greatest(0, rb - 2) + greatest(0, wr - 2) + greatest(0, te - 1) AS bench, qb >= 1 AND rb >= 2 AND wr >= 2 AND te >= 1 AS startable FROM r""",
)
def array_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deficits of a roster against its places, by maps and higher-order functions."""
    need = F.create_map(*[F.lit(x) for kv in sim.STARTERS.items() for x in kv])
    r = table(spark, sf_dir, "season_points").select("season", "player_id", "position", F.element_at(F.split("team", "/"), 1).alias("team")).distinct().groupBy("season", "team", "position").agg(F.count("*").alias("n"))
    m = r.groupBy("season", "team").agg(F.map_from_entries(F.collect_list(F.struct("position", "n"))).alias("have"))
    have = lambda p: F.coalesce(F.try_element_at("have", p), F.lit(0).cast("long"))
    total = lambda f: F.aggregate(F.map_keys(need), F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.lit(0).cast("long"), f(p)))
    missing, bench = total(lambda p: F.element_at(need, p) - have(p)), total(lambda p: have(p) - F.element_at(need, p))
    return m.select("season", "team", missing.alias("missing"), bench.alias("bench"), (missing == 0).alias("startable"))


@query("tool_functions", "SELECT player_id, doc_id, source FROM documents WHERE player_id IS NOT NULL AND published_ms < 1700000000000 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY published_ms DESC, doc_id) <= 3")
def tool_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool 'news(as_of, n)' for every player at once."""
    return TOOLS["news"](spark, sf_dir, as_of=1_700_000_000_000, n=3).select("player_id", "doc_id", "source")


def news(spark: SparkSession, sf_dir: str, as_of: int, n: int) -> DataFrame:
    """The ``n`` latest documents of each player strictly before ``as_of``."""
    d = table(spark, sf_dir, "documents").where(F.col("player_id").isNotNull() & (F.col("published_ms") < as_of))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("player_id").orderBy(F.col("published_ms").desc(), "doc_id"))).where(F.col("_r") <= n).drop("_r")


def depth(spark: SparkSession, sf_dir: str, season: int, week: int) -> DataFrame:
    """The latest depth row of each player up to a week."""
    d = table(spark, sf_dir, "depth_weekly").where((F.col("season") == season) & (F.col("week") <= week))
    return d.groupBy("gsis_id").agg(F.max_by(F.struct("week", "depth_team", "club_code"), F.struct("week", "loaded_at", "depth_id")).alias("x")).select("gsis_id", "x.*")


TOOLS = {"news": news, "depth": depth}


@query(
    "contender_registry",
    """WITH r AS (SELECT season, player_id, max(total_ppr) AS ppr, max(games) AS games FROM season_points GROUP BY 1, 2), c AS (SELECT season + 1 AS season, 'last_total' AS contender, player_id, ppr AS score FROM r UNION ALL SELECT season + 1, 'per_game', player_id, ppr / nullif(games, 0) FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY season, contender ORDER BY score DESC NULLS LAST, player_id) AS rk FROM c), t AS (SELECT season, player_id, row_number() OVER (PARTITION BY season ORDER BY ppr DESC, player_id) AS actual FROM r)
SELECT season, contender, count_if(actual <= 20) AS hits FROM k JOIN t USING (season, player_id) WHERE rk <= 20 GROUP BY 1, 2""",
)
def contender_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of several contenders, scored alike: how many of their first 20 finish there."""
    r = table(spark, sf_dir, "season_points").groupBy("season", "player_id").agg(F.max("total_ppr").alias("ppr"), F.max("games").alias("games"))
    contenders = {"last_total": F.col("ppr"), "per_game": F.try_divide("ppr", "games")}
    c = r.select((F.col("season") + 1).alias("season"), "player_id", F.explode(F.array(*[F.struct(F.lit(n).alias("contender"), s.alias("score")) for n, s in contenders.items()])).alias("x")).select("season", "player_id", "x.*")
    k = c.withColumn("rk", F.row_number().over(Window.partitionBy("season", "contender").orderBy(F.col("score").desc_nulls_last(), "player_id"))).where("rk <= 20")
    t = r.select("season", "player_id", F.row_number().over(Window.partitionBy("season").orderBy(F.col("ppr").desc(), "player_id")).alias("actual"))
    return k.join(t, ["season", "player_id"]).groupBy("season", "contender").agg(F.count_if(F.col("actual") <= 20).alias("hits"))
