"""Glicko-2 ratings: one update of many players at once, in rating periods, and folds of single players.

In a period in which every player plays once this is the match-by-match rule: both sides are rated with
what they had before the match. Several matches of a player in a period are rated together, as the
published method has it. Who does not play keeps rating and deviation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Points of rating to a unit of mu, starting deviation and volatility, and how far volatility may move.
SCALE, DEVIATION, VOLATILITY, TAU = 173.7178, 350.0, 0.06, 0.5


def damped(phi: Column) -> Column:
    """How much a result against a player of this deviation counts."""
    return 1 / F.sqrt(1 + 3 * phi * phi / F.lit(np.pi**2))


def volatility(phi: np.ndarray, sigma: np.ndarray, v: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """New volatilities: the roots of the method's equation, by the Illinois variant of false position for all rows at once."""
    a = np.log(sigma * sigma)

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / TAU**2

    over = delta**2 - phi**2 - v
    right = np.where(over > 0, np.log(np.maximum(over, 1e-300)), a - TAU)
    for k in range(2, 21):  # step down until the root is enclosed
        low = (over <= 0) & (f(right) < 0)
        if not low.any():
            break
        right = np.where(low, a - k * TAU, right)
    left, fl, fr = a, f(a), f(right)
    for _ in range(30):
        open_ = (np.abs(fr - fl) >= 1e-12) & (np.abs(right - left) >= 1e-6)
        if not open_.any():
            break
        mid = np.where(open_, left + (left - right) * fl / np.where(open_, fr - fl, 1.0), right)
        fm = f(mid)
        cross = fm * fr <= 0
        left, fl = np.where(open_ & cross, right, left), np.where(open_, np.where(cross, fr, fl / 2), fl)
        right, fr = mid, fm
    return np.exp(right / 2)


def updated(mu: np.ndarray, phi: np.ndarray, sigma: np.ndarray, information: np.ndarray, surprise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mu, phi, sigma after results of total ``information`` (1 / v) and ``surprise`` (damped scores above what was expected)."""
    v = 1 / np.maximum(information, 1e-12)
    sigma = volatility(phi, sigma, v, v * surprise)
    phi = 1 / np.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    return mu + phi**2 * surprise, phi, sigma


def update_column(mu: str, phi: str, sigma: str, information: str, surprise: str) -> Column:
    """A struct of the new mu, phi and sigma."""

    def update(mu: pd.Series, phi: pd.Series, sigma: pd.Series, information: pd.Series, surprise: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("mu", "phi", "sigma"), updated(*(x.to_numpy(float) for x in (mu, phi, sigma, information, surprise))), strict=True)))

    return F.pandas_udf(update, "struct<mu: double, phi: double, sigma: double>")(mu, phi, sigma, information, surprise)


def rate(matches: DataFrame, periods: list) -> DataFrame:
    """player, mu, phi, sigma, played after ``periods`` (in order) of matches (period, winner, loser).

    Matches with a missing side or the same player twice do not count. A step is a few joins and a sum
    over players; only the number of periods is sequential, and the states are a new table after each.
    """
    ok = matches.where("winner is not null and loser is not null and winner <> loser")
    sides = ok.select("period", F.explode(F.array(
        F.struct(F.col("winner").alias("player"), F.col("loser").alias("other"), F.lit(1.0).alias("won")),
        F.struct(F.col("loser").alias("player"), F.col("winner").alias("other"), F.lit(0.0).alias("won")),
    )).alias("s")).select("period", "s.*")
    sides = cut(sides.groupBy("period", "player", "other").agg(F.sum("won").alias("won"), F.count("*").alias("n")), "sides")
    state = cut(sides.select("player").distinct().select(
        "player", F.lit(0.0).alias("mu"), F.lit(DEVIATION / SCALE).alias("phi"), F.lit(VOLATILITY).alias("sigma"), F.lit(0).cast("long").alias("played")
    ), "ratings")
    for period in periods:
        theirs = state.select(F.col("player").alias("other"), F.col("mu").alias("omu"), damped(F.col("phi")).alias("g"))
        rows = sides.where(F.col("period") == F.lit(period)).join(theirs, "other").join(state.select("player", "mu"), "player")
        e = 1 / (1 + F.exp(-F.col("g") * (F.col("mu") - F.col("omu"))))
        got = rows.groupBy("player").agg(
            F.sum(F.col("n") * F.col("g") * F.col("g") * e * (1 - e)).alias("information"), F.sum(F.col("g") * (F.col("won") - F.col("n") * e)).alias("surprise"), F.sum("n").alias("n")
        )
        new = state.join(got, "player", "left")
        u = update_column("mu", "phi", "sigma", "information", "surprise")
        new = new.withColumn("u", F.when(F.col("n").isNull(), F.struct("mu", "phi", "sigma")).otherwise(u))
        state = cut(new.select("player", "u.mu", "u.phi", "u.sigma", (F.col("played") + F.coalesce("n", F.lit(0))).alias("played")), "ratings", instead_of=state)
    return state


def player_folds(results: DataFrame, load_days: int = 7, recent: int = 10) -> DataFrame:
    """One row a player of results (player, at, result, won): state after the last result, each played against a neutral opponent.

    elo, mu, phi, sigma, played, wins, load (results of the last days, the last included) and form (share
    won of the last results). Results come sorted to the tasks and are read batch by batch, the next result of
    every player of a batch at once; what is carried over is the state of the batch's last player. Rows without
    player, time or outcome take no part.
    """
    rows = results.select(F.col("player").cast("long").alias("player"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("result").cast("long").alias("result"), F.col("won").cast("int").alias("won")).dropna()
    span = load_days * 86_400_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = DEVIATION / SCALE
        g = 1 / np.sqrt(1 + 3 * one * one / np.pi**2)
        # The last player's number, state, and the times and outcomes that load and form still need.
        key, carried, times, last = None, None, np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            player, at, won = (b.column(c).to_numpy() for c in ("player", "at", "won"))
            start = np.flatnonzero(np.append(True, player[1:] != player[:-1]))
            end = np.append(start[1:], len(player))
            state = np.tile(np.array([1500.0, 0.0, one, VOLATILITY, 0.0, 0.0]), (len(start), 1))
            if key is not None and player[0] != key:
                yield _told([key], carried[None], [_load_and_form(times, last, span, recent)])
                times, last = times[:0], last[:0]
            elif key is not None:
                state[0] = carried
            by_size = np.argsort(start - end, kind="stable")
            size = (end - start)[by_size]
            for k in range(int(size[0])):
                live = by_size[: int(np.searchsorted(-size, -k, "left"))]
                w, s = won[start[live] + k], state[live]
                s[:, 0] += 32.0 * (w - 1 / (1 + 10 ** ((1500.0 - s[:, 0]) / 400)))
                e = 1 / (1 + np.exp(-g * s[:, 1]))
                s[:, 1:4] = np.stack(updated(s[:, 1], s[:, 2], s[:, 3], g * g * e * (1 - e), g * (w - e)), 1)
                s[:, 4] += 1
                s[:, 5] += w
                state[live] = s
            ends = []
            for a, z in zip(start.tolist(), end.tolist(), strict=True):
                times, last = (np.append(times, at[a:z]), np.append(last, won[a:z])) if a == 0 else (at[a:z], won[a:z])
                ends.append(_load_and_form(times, last, span, recent))
            if len(start) > 1:
                yield _told(player[start[:-1]], state[:-1], ends[:-1])
            key, carried = int(player[-1]), state[-1]
            times, last = times[times > times[-1] - span], last[-recent:]
        if key is not None:
            yield _told([key], carried[None], [_load_and_form(times, last, span, recent)])

    kinds = "player long, elo double, mu double, phi double, sigma double, played long, wins long, load long, form double"
    return rows.repartition("player").sortWithinPartitions("player", "at", "result").select("player", "at", "won").mapInArrow(fold, kinds)


_COLUMNS = ["player", "elo", "mu", "phi", "sigma", "played", "wins", "load", "form"]


def _load_and_form(times: np.ndarray, won: np.ndarray, span: int, recent: int) -> tuple[int, float]:
    return int((times > times[-1] - span).sum()), float(won[-recent:].mean())


def _told(players: np.ndarray | list, state: np.ndarray, ends: list[tuple[int, float]]) -> pa.RecordBatch:
    numbers = [pa.array(state[:, c].astype(np.int64) if c > 3 else state[:, c]) for c in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(players, pa.int64()), *numbers, pa.array([x for x, _ in ends], pa.int64()), pa.array([x for _, x in ends], pa.float64())], names=_COLUMNS)
