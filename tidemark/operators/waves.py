"""Ratings that follow every single match: Elo, Elo by surface, Glicko-2 and serve rates before each match.

A match hangs on the earlier matches of its two players, and on no others. Matches are cut into slices
of the order of time; a slice's matches fall into components that share no player, and these are folded
apart from each other. In a component a match's wave is one more than the last wave of its players:
matches of a wave share no player and are rated at once. Between slices the players' states are a
table, written anew once a slice, so only the number of slices is sequential on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .glicko import DEVIATION, SCALE, VOLATILITY, updated
from .ranking import ranked

START, SPREAD = 1500.0, 400.0
#: What serve and return rates are drawn to, by how many points, and their limits.
SERVE, RETURN, PRIOR_POINTS = 0.62, 0.38, 200.0
SERVE_LIMITS, RETURN_LIMITS = (0.35, 0.9), (0.1, 0.65)
DAY = 86_400_000_000
#: Matches of a slice, and of one that is folded without a search for its components.
SLICE, ALONE = 1_000_000, 50_000


class Rule(NamedTuple):
    """How results move the ratings."""

    step: float = 32.0
    #: With ``novice`` the step falls as novice / (novice + matches played), but not under ``least_step``.
    novice: float = 0.0
    least_step: float = 8.0
    #: The deviation grows by the volatility for each such number of days without a match.
    idle_days: float | None = 30.0
    #: A player's first rating on a surface is the overall one at that time, else START.
    surface_from_overall: bool = False
    #: Serve points count only where both sides have them.
    both_serves: bool = True
    #: First ratings by the level of a player's first match.
    priors: tuple[tuple[str, float], ...] = ()


RESULTS = Rule()
#: First ratings by level.
HISTORY = Rule(
    novice=15.0, idle_days=None, surface_from_overall=True, both_serves=False,
    priors=(
        ("grand_slam", 1650.0), ("masters", 1600.0), ("atp", 1550.0), ("wta", 1550.0), ("atp250", 1550.0), ("atp500", 1560.0), ("challenger", 1450.0), ("itf", 1350.0),
        ("unknown", 1500.0),
    ),
)

_NUMBERS = ["elo", "mu", "phi", "sigma", "played", "wins", "last", "serve_points", "serve_won", "serve_residual", "return_points", "return_won", "return_residual"]
_SERVES = ["winner_points", "winner_won", "loser_points", "loser_won"]
_MATCH = ["match_id", "played_at", "winner", "loser", "surface", "level", *_SERVES]
_BEFORE = ["surface_elo", *_NUMBERS]


def current_matches(matches: DataFrame, cutoff: str | None = None) -> DataFrame:
    """The latest version of each match that was known at ``cutoff``, without those that are void or have no two sides.

    ``matches``: match_id, available_at, played_at, winner, loser, surface, level, valid and the serve
    points of both sides. Of versions of one time the greatest by its columns counts. A version that
    is not valid takes its match away.
    """
    ok = matches.where("match_id is not null and winner is not null and loser is not null and winner <> loser and available_at is not null and played_at is not null")
    if cutoff:
        at = F.lit(cutoff).cast("timestamp_ntz")
        ok = ok.where((F.col("available_at") <= at) & (F.col("played_at") <= at))
    newest = ok.groupBy("match_id").agg(F.max(F.struct("available_at", *(c for c in _MATCH if c != "match_id"), "valid")).alias("m"))
    rows = newest.select("match_id", "m.*").where("valid").drop("valid", "available_at")
    return rows.withColumns({"surface": F.lower(F.coalesce("surface", F.lit("unknown"))), "level": F.lower(F.coalesce("level", F.lit("unknown")))})


def components(edges: DataFrame) -> DataFrame:
    """player, component of edges (winner, loser): the smallest player that can be reached.

    Each round takes the smallest label among a player's matches and then that label's own label, so
    rounds grow with the logarithm of the longest way.
    """
    edges = cut(edges.select("winner", "loser").distinct(), "edges")
    both = edges.union(edges.select("loser", "winner")).toDF("player", "other")
    labels = cut(both.groupBy("player").agg(F.least(F.min("player"), F.min("other")).alias("component")), "labels")
    while True:
        theirs = labels.toDF("other", "their")
        near = both.join(theirs, "other").groupBy("player").agg(F.min("their").alias("their"))
        step = labels.join(near, "player").select("player", "component", F.least("component", "their").alias("next"))
        jump = labels.toDF("next", "far")
        new = cut(step.join(jump, "next").select("player", "component", F.least("next", "far").alias("next")), "labels")
        stable = new.where("next <> component").isEmpty()
        labels = cut(new.select("player", F.col("next").alias("component")), "labels", instead_of=labels)
        if stable:
            return labels


def slice_components(edges: DataFrame) -> DataFrame:
    """The same as ``components`` for the edges of one slice, in one pass of one task: a slice's length bounds its players."""
    player = edges.schema["winner"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, high = sorted((top(x), top(y)))
                above[high] = low
        names = list(above)
        for k in range(0, len(names), 100_000):
            own = names[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array([top(x) for x in own], kind)], names=["player", "component"])

    dealt = edges.select("winner", "loser").distinct().repartition(1)
    return cut(dealt.mapInArrow(run, f"player {player}, component {player}"), "components")


def fold_matches(matches: DataFrame, rule: Rule = RESULTS, slice_rows: int = SLICE, alone: int = ALONE) -> tuple[DataFrame, DataFrame]:
    """Both sides' states before each match, and each player's state after the last one.

    ``matches``: rows as of ``current_matches``, which count in the order of played_at and match_id.
    Before: match_id, player, won, elo, surface_elo, mu, phi, sigma, played, wins, last (the last
    match's time, null at first), serve and return points. After: player, surface ('' for the state
    as a whole, with all numbers; else only elo). An empty table gives two empty tables.
    """
    spark = matches.sparkSession
    rows = matches.select(*[c for c in _MATCH if c != "played_at"], F.unix_micros(F.col("played_at").cast("timestamp")).alias("played_at"))
    rows = cut(ranked(rows, ["played_at", "match_id"], "k").withColumn("slice", F.expr(f"(k - 1) div {slice_rows}")), "matches")
    player, match = (rows.schema[c].dataType.simpleString() for c in ("winner", "match_id"))
    numbers = ", ".join(f"{c} {'long' if c in ('played', 'wins', 'last') else 'double'}" for c in _NUMBERS)
    state_kind = f"player {player}, surface string, {numbers}"
    out_kind = f"match_id {match}, player {player}, won boolean, surface string, surface_elo double, {numbers}"
    state = cut(spark.createDataFrame([], state_kind), "states")
    slices = rows.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()  # one row a slice
    outs = []

    def fold(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _fold(left, right, rule)

    for s in slices:
        now = rows.where(F.col("slice") == s.slice)
        players = now.select(F.explode(F.array("winner", "loser")).alias("player")).distinct()
        if s.n > alone:
            found = slice_components(now)
            now = now.join(found.withColumnRenamed("player", "winner"), "winner")
            players = found.toDF("player", "own")
        else:
            now, players = now.withColumn("component", F.lit(0)), players.withColumn("own", F.lit(0))
        known = state.join(players, "player")
        got = now.select("component", "k", *_MATCH).groupBy("component").cogroup(known.groupBy("own")).applyInArrow(fold, out_kind)
        got = cut(got, "states_by_match")
        outs.append(got)
        after = got.where("match_id is null").select("player", "surface", *_NUMBERS)
        state = cut(state.join(after, ["player", "surface"], "left_anti").union(after), "states", instead_of=state)
    before = spark.read.schema(out_kind).parquet(*[x._cut_path for x in outs]) if outs else spark.createDataFrame([], out_kind)
    return before.where("match_id is not null").drop("surface").withColumn("last", F.timestamp_micros("last")), state


def _codes(*columns: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Small whole numbers for the values of several columns together, and the values."""
    encoded = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]).dictionary_encode()
    flat = encoded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(c) for c in columns])
    return np.split(flat, ends[:-1]), encoded.dictionary


def _waves(a: np.ndarray, b: np.ndarray, players: int) -> list[np.ndarray]:
    """Matches by wave; the matches come in order."""
    last, wave = [0] * players, np.empty(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        wave[k] = last[x] = last[y] = max(last[x], last[y]) + 1
    order = np.argsort(wave, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(wave[order])) + 1) if len(order) else []


def chance(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return 1 / (1 + 10 ** ((other - own) / SPREAD))


def _fold(matches: pa.Table, states: pa.Table, rule: Rule) -> pa.Table:
    """Rows before each match (two a match), and the states after the last (without a match)."""
    matches = matches.sort_by("k")
    whole = states.filter(pa.compute.equal(states["surface"], ""))
    by_surface = states.filter(pa.compute.not_equal(states["surface"], ""))
    (a, b, known, held), names = _codes(matches["winner"], matches["loser"], whole["player"], by_surface["player"])
    (where, own_surface), surfaces = _codes(matches["surface"], by_surface["surface"])
    s = _first_states(matches, a, b, len(names), rule)
    for c in _NUMBERS:
        s[c][known] = whole[c].to_numpy()
    width = max(len(surfaces), 1)
    keys, inverse = np.unique(np.concatenate([a * width + where, b * width + where, held * width + own_surface]), return_inverse=True)
    sa, sb, sheld = np.split(inverse, [len(a), 2 * len(a)])
    surface_elo = np.full(len(keys), np.nan)
    surface_elo[sheld] = by_surface["elo"].to_numpy()
    at = matches["played_at"].to_numpy()
    serves = [matches[c].to_numpy(zero_copy_only=False).astype(float) for c in _SERVES]
    before = {c: np.empty((2, len(a))) for c in _BEFORE}
    for m in _waves(a, b, len(names)):
        sides = (a[m], sa[m]), (b[m], sb[m])
        first = [np.where(np.isnan(surface_elo[z]), s["elo"][x] if rule.surface_from_overall else START, surface_elo[z]) for x, z in sides]
        for k, (x, _) in enumerate(sides):
            before["surface_elo"][k, m] = first[k]
            for c in _NUMBERS:
                before[c][k, m] = s[c][x]
        _rate(s, surface_elo, sides, first, at[m], rule)
        _serve(s, [x for x, _ in sides], [v[m] for v in serves], rule)
        for k, (x, _) in enumerate(sides):
            s["played"][x] += 1
            s["wins"][x] += 1 - k
            s["last"][x] = at[m]
    return _rows(matches, names, surfaces, (a, b), before, s, keys, surface_elo, width)


def _first_states(matches: pa.Table, a: np.ndarray, b: np.ndarray, players: int, rule: Rule) -> dict[str, np.ndarray]:
    s = {c: np.zeros(players) for c in _NUMBERS}
    s["elo"] += START
    if rule.priors:
        both = np.stack([a, b], 1).ravel()
        who, first = np.unique(both, return_index=True)
        prior = dict(rule.priors)
        levels = matches["level"].to_pylist()
        s["elo"][who] = [prior.get(levels[k // 2], START) for k in first.tolist()]
        s["mu"] = (s["elo"] - START) / SCALE
    s["phi"] += DEVIATION / SCALE
    s["sigma"] += VOLATILITY
    s["last"] += np.nan
    return s


def _rate(s: dict, surface_elo: np.ndarray, sides: tuple, first: list[np.ndarray], at: np.ndarray, rule: Rule) -> None:
    """Both sides move from what both had before the match."""
    elo, mu, sigma, phi = [], [], [], []
    for x, _ in sides:
        elo.append(s["elo"][x])
        mu.append(s["mu"][x])
        sigma.append(s["sigma"][x])
        p = s["phi"][x]
        if rule.idle_days:
            idle = np.nan_to_num(np.floor(np.maximum(at - s["last"][x], 0) / (rule.idle_days * DAY)))
            p = np.minimum(DEVIATION / SCALE, np.sqrt(p * p + idle * sigma[-1] ** 2))
        phi.append(p)
    over, on_surface = chance(elo[0], elo[1]), chance(first[0], first[1])
    for k, (x, z) in enumerate(sides):
        step = np.maximum(rule.least_step, rule.step * rule.novice / (rule.novice + s["played"][x])) if rule.novice else rule.step
        sign = 1 - 2 * k
        s["elo"][x] = elo[k] + sign * step * (1 - over)
        gain = sign * step * (1 - (over if rule.surface_from_overall else on_surface))
        surface_elo[z] = first[k] + gain
        g = 1 / np.sqrt(1 + 3 * phi[1 - k] ** 2 / np.pi**2)
        e = 1 / (1 + np.exp(-g * (mu[k] - mu[1 - k])))
        s["mu"][x], s["phi"][x], s["sigma"][x] = updated(mu[k], phi[k], sigma[k], g * g * e * (1 - e), g * ((1 - k) - e))


def serve_rate(points, residual):
    return np.clip(SERVE + residual / (PRIOR_POINTS + points), *SERVE_LIMITS)


def return_rate(points, residual):
    return np.clip(RETURN + residual / (PRIOR_POINTS + points), *RETURN_LIMITS)


def serve_rate_column(points: str, residual: str) -> Column:
    return F.greatest(F.lit(SERVE_LIMITS[0]), F.least(F.lit(SERVE_LIMITS[1]), SERVE + F.col(residual) / (PRIOR_POINTS + F.col(points))))


def return_rate_column(points: str, residual: str) -> Column:
    return F.greatest(F.lit(RETURN_LIMITS[0]), F.least(F.lit(RETURN_LIMITS[1]), RETURN + F.col(residual) / (PRIOR_POINTS + F.col(points))))


def _serve(s: dict, sides: list[np.ndarray], serves: list[np.ndarray], rule: Rule) -> None:
    """Points won on serve and return, and how far they are from what the other side's rates let expect."""
    ok = [(p > 0) & (w >= 0) & (w <= p) if rule.both_serves else p > 0 for p, w in (serves[:2], serves[2:])]
    if rule.both_serves:
        ok = [ok[0] & ok[1]] * 2
    rates = [(serve_rate(s["serve_points"][x], s["serve_residual"][x]), return_rate(s["return_points"][x], s["return_residual"][x])) for x in sides]
    for k, x in enumerate(sides):
        keep, (points, won) = ok[k], serves[2 * k : 2 * k + 2]
        x, y, points, won = x[keep], sides[1 - k][keep], points[keep], won[keep]
        s["serve_points"][x] += points
        s["serve_won"][x] += won
        s["serve_residual"][x] += won - points * (1 - rates[1 - k][1][keep])
        s["return_points"][y] += points
        s["return_won"][y] += points - won
        s["return_residual"][y] += points - won - points * (1 - rates[k][0][keep])


def _rows(matches: pa.Table, names: pa.Array, surfaces: pa.Array, sides: tuple, before: dict, s: dict, keys: np.ndarray, surface_elo: np.ndarray, width: int) -> pa.Table:
    n, players = len(sides[0]), len(names)
    kept = np.flatnonzero(~np.isnan(surface_elo))
    ids = matches["match_id"].combine_chunks()
    nothing = pa.nulls(players + len(kept), ids.type)
    who = pa.concat_arrays([names.take(pa.array(x)) for x in (*sides, np.arange(players), keys[kept] // width)])
    on = pa.concat_arrays([pa.nulls(2 * n, pa.string()), pa.array([""] * players, pa.string()), surfaces.take(pa.array(keys[kept] % width)).cast(pa.string())])
    won = pa.array([True] * n + [False] * n + [None] * (players + len(kept)), pa.bool_())
    columns = [pa.concat_arrays([ids, ids, nothing]), who, won, on, pa.array(np.concatenate([before["surface_elo"].ravel(), np.full(players + len(kept), np.nan)]))]
    for c in _NUMBERS:
        last = surface_elo[kept] if c == "elo" else np.zeros(len(kept)) if c != "last" else np.full(len(kept), np.nan)
        x = pa.array(np.concatenate([before[c].ravel(), s[c], last]), from_pandas=True)
        columns.append(x.cast(pa.int64()) if c in ("played", "wins", "last") else x)
    return pa.table(columns, names=["match_id", "player", "won", "surface", "surface_elo", *_NUMBERS])
