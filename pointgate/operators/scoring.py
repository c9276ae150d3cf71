"""Weighted scores, label gates, bands and windows as column expressions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgate.functions.scalar import half_even


@dataclass(frozen=True)
class Scoring:
    """Weights per stat, and overrides per position."""

    weights: dict[str, float]
    overrides: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = {s for o in self.overrides.values() for s in o} - set(self.weights)
        if unknown:
            raise ValueError(f"overrides of unknown stats: {sorted(unknown)}")

    def fingerprint(self) -> str:
        """The first 12 hexadecimal digits of the SHA-256 of the sorted JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def number(c: Column) -> Column:
    """Null, '' and 'NA' count as 0."""
    return F.coalesce(F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("NA")).try_cast("double"), F.lit(0.0))


def weighted_score(df: DataFrame, scoring: Scoring, stats: dict[str, Column], position: Column, name: str = "score") -> DataFrame:
    """``df`` with the score: every contribution rounded to 4 decimals, their sum to 2, both half to even by the binary value.

    Steps are columns of their own, so that each is computed once.
    """
    parts = {}
    for stat, weight in scoring.weights.items():
        w: Column = F.lit(weight)
        for p, o in scoring.overrides.items():
            if stat in o:
                w = F.when(position == p, F.lit(o[stat])).otherwise(w)
        parts[f"_{stat}"] = stats[stat] * w
    x = df.withColumns(parts)
    x = x.withColumns({p: half_even(F.col(p), 4) for p in parts})
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p)
    return x.withColumn("_total", total).withColumn(name, half_even(F.col("_total"), 2)).drop("_total", *parts)


#: Ranks up to which a position counts, and beyond which it was not expected to.
FINISH_GATE = {"QB": 12, "TE": 12, "RB": 24, "WR": 24}
MARKET_GATE = {"QB": 18, "TE": 18, "RB": 40, "WR": 40}


def by_position(position: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), position)


#: A bust was expected among the first of its position and ends beyond these.
BUST_MARKET_GATE, BUST_FINISH_GATE, INJURY_GAMES = 12, 24, 8


def position_label(position: Column, market: Column, finish: Column, games: Column) -> Column:
    """struct (alpha, breakout, bust, injury_bust) of a rank expected and a rank reached, by the gates of the position.

    Without a finish there is no breakout and no injury bust; a null market rank gives no label.
    """
    breakout = (finish <= by_position(position, FINISH_GATE)) & (market > by_position(position, MARKET_GATE))
    bust = (market <= BUST_MARKET_GATE) & (finish.isNull() | (finish > BUST_FINISH_GATE))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct((market - finish).alias("alpha"), yes(breakout).alias("breakout"), yes(bust).alias("bust"), yes(bust & finish.isNotNull() & (games < INJURY_GAMES)).alias("injury_bust"))


def band(offset: Column) -> Column:
    """How far past its gate a rank is."""
    return F.when(offset <= 12, "near_gate").when(offset <= 30, "mid").otherwise("deep")


def price_window(price: Column, picks: Column) -> Column:
    """Where a price falls between the picks one holds: struct (last pick at or before, next after, window)."""
    before = F.array_max(F.filter(picks, lambda p: p <= price))
    after = F.array_min(F.filter(picks, lambda p: p > price))
    kind = F.when(before.isNull(), "before_first").when(after.isNull(), "after_last").when(price - before <= after - price, "reach_back").otherwise("wait")
    return F.struct(before.alias("before"), after.alias("after"), kind.alias("window"))


def shrink(anchor: Column, target: Column) -> Column:
    """``clip(anchor + clip(target - anchor, ±.15) / 3, .08, .85)``."""
    step = F.least(F.greatest(target - anchor, F.lit(-0.15)), F.lit(0.15)) / 3
    return F.least(F.greatest(anchor + step, F.lit(0.08)), F.lit(0.85))


def american_odds(odds: Column) -> Column:
    """Probability behind American odds; 0 is an error."""
    p = F.when(odds > 0, 100.0 / (odds + 100.0)).when(odds < 0, -odds / (-odds + 100.0))
    return F.when(odds == 0, F.raise_error(F.lit("odds of 0")).cast("double")).otherwise(p)


def normal_cdf(x: Column) -> Column:
    """Normal distribution by the rational approximation of erf with five terms (error under 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x >= 0, erf).otherwise(-erf))


def relative_edge(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, F.greatest(a, b))
