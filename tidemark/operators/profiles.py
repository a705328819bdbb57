"""A player's profile from their own results: counts, windows of time, serve, load, and ratings against a neutral opponent.

All but the ratings are sums over slices of a player's history. Ratings are rounded after every result,
so they are folded in order: the rows of an Arrow batch go side by side, the next result of every player
in it at once, and only the state of the batch's last player is carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .glicko import DEVIATION, SCALE, VOLATILITY, updated

START, SPREAD, STEP = 1500.0, 400.0, 32.0
#: Results that are kept whatever their age, and days.
LAST, WINDOWS = (10, 20), (90, 365)


def profile_rows(results: DataFrame) -> DataFrame:
    """player, kind, name, matches, wins, win_rate (null for no matches), points, points_won, sets.

    ``results``: player, at, result (an id), won, surface, level, serve_points, serve_won, sets. Kinds:
    ``overall``, ``surface``, ``level``, ``last`` (10 and 20 results), ``days`` (90, and 365 with the last
    20 results whatever their age), ``load`` (7 and 30 days), all up to the player's last result, its
    time included; ``serve`` with the matches whose serve points are not known. Rows without player,
    time or outcome take no part; null surfaces and levels are ``unknown``; ties go by result.
    """
    rows = results.where("player is not null and at is not null and won is not null").withColumns({
        "surface": F.lower(F.coalesce("surface", F.lit("unknown"))), "level": F.coalesce("level", F.lit("unknown")), "w": F.col("won").cast("long"), "sets": F.coalesce(F.col("sets").cast("long"), F.lit(0)),
    })
    known = F.coalesce((F.col("serve_points") > 0) & F.col("serve_won").isNotNull(), F.lit(False))
    latest = rows.groupBy("player").agg(F.max("at").alias("latest"))
    # The twentieth result from the end: top rows are cut in each task before they are shuffled.
    order = Window.partitionBy("player").orderBy(F.desc("at"), F.desc("result"))
    newest = rows.select("player", "at", "result", "w").withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(LAST))
    age = lambda days: F.col("at") >= F.col("latest") - F.expr(f"interval {days} days")
    top = newest.groupBy("player").agg(*[x.alias(f"{x_name}_last_{n}") for n in LAST for x_name, x in (("matches", F.count_if(F.col("k") <= n)), ("wins", F.sum(F.when(F.col("k") <= n, F.col("w")))))])
    old = newest.join(latest, "player").groupBy("player").agg(F.count_if(~age(WINDOWS[1])).alias("old"), F.coalesce(F.sum(F.when(~age(WINDOWS[1]), F.col("w"))), F.lit(0)).alias("old_wins"))
    spans = (*WINDOWS, 7, 30)
    sums = rows.join(latest, "player").groupBy("player").agg(
        F.count("*").alias("n"), F.sum("w").alias("n_wins"), F.sum(F.when(known, F.col("serve_points"))).alias("sp"), F.sum(F.when(known, F.col("serve_won"))).alias("sw"), F.count_if(~known).alias("unknown"),
        *[F.coalesce(x, F.lit(0)).alias(f"{c}_{d}") for d in spans for c, x in (("matches", F.count_if(age(d))), ("wins", F.sum(F.when(age(d), F.col("w")))), ("sets", F.sum(F.when(age(d), F.col("sets")))))],
    )

    def told(kind, name, matches, wins, points=None, points_won=None, sets=None):
        cell = lambda x, t, c: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(t).alias(c)
        name = F.lit(name) if isinstance(name, str) else name
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), name.alias("name"), cell(matches, "long", "matches"), cell(wins, "long", "wins"), cell(points, "double", "points"), cell(points_won, "double", "points_won"), cell(sets, "long", "sets"))

    year = (F.col("matches_365") + F.col("old"), F.col("wins_365") + F.col("old_wins"))
    cells = [told("overall", "", "n", "n_wins"), *[told("last", str(n), f"matches_last_{n}", f"wins_last_{n}") for n in LAST], told("days", "90", "matches_90", "wins_90"), told("days", "365", *year)]
    cells += [told("load", str(d), f"matches_{d}", f"wins_{d}", sets=f"sets_{d}") for d in (7, 30)]
    cells.append(told("serve", "", "unknown", F.lit(0), F.coalesce("sp", F.lit(0.0)), F.coalesce("sw", F.lit(0.0))))
    out = sums.join(top, "player").join(old, "player").select("player", F.explode(F.array(*cells)).alias("c"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("surface", "level")]))
    tallies = rows.select("player", "w", both.alias("c")).groupBy("player", "c.kind", "c.name").agg(F.count("*").alias("matches"), F.sum("w").alias("wins"))
    out = out.union(tallies.select("player", told(F.col("kind"), F.col("name"), "matches", "wins").alias("c"))).select("player", "c.*")
    return out.withColumn("win_rate", F.when((F.col("matches") > 0) & (F.col("kind") != "serve"), F.round(F.col("wins") / F.col("matches"), 6)))


def elo_step(rating: np.ndarray, won: np.ndarray) -> np.ndarray:
    return np.round(rating + STEP * (won - 1 / (1 + 10 ** ((START - rating) / SPREAD))), 3)


def glicko_step(rating: np.ndarray, rd: np.ndarray, sigma: np.ndarray, won: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One result against a neutral opponent of the starting deviation, rounded as it is kept."""
    other = DEVIATION / SCALE
    g = 1 / np.sqrt(1 + 3 * other * other / np.pi**2)
    mu = (rating - START) / SCALE
    e = 1 / (1 + np.exp(-g * mu))
    mu, phi, sigma = updated(mu, rd / SCALE, sigma, g * g * e * (1 - e), g * (won - e))
    return np.round(START + SCALE * mu, 3), np.round(SCALE * phi, 3), np.round(sigma, 6)


_STATE = ["elo", "rating", "rd", "volatility", "matches"]
_FIRST = [START, START, DEVIATION, VOLATILITY, 0.0]


def rating_folds(results: DataFrame) -> DataFrame:
    """player, surface ('' for all results), elo, deviation, rating, rd, volatility, matches after the last result.

    Of a surface only elo and matches are told. Each result is followed in order of time, then id.
    """
    rows = results.where("player is not null and at is not null and won is not null")
    rows = rows.select("player", F.explode(F.array(F.lit(""), F.lower(F.coalesce("surface", F.lit("unknown"))))).alias("surface"), F.col("at").alias("at"), "result", F.col("won").cast("double").alias("won"))
    kind = rows.schema["player"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[tuple, np.ndarray] | None = None
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            player, surface = batch.column(0), batch.column(1)
            new = np.ones(batch.num_rows, bool)
            new[1:] = ~(np.asarray(pa.compute.equal(player[1:], player[:-1])) & np.asarray(pa.compute.equal(surface[1:], surface[:-1])))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, batch.num_rows))
            state = np.tile(np.array(_FIRST), (len(start), 1))
            if carried:
                if carried[0] == (player[0], surface[0]):
                    state[0] = carried[1]
                else:
                    yield _told(schema, [carried[0]], carried[1][None])
            won = batch.column(2).to_numpy(zero_copy_only=False)
            by_size = np.argsort(-size, kind="stable")
            for k in range(int(size.max())):
                live = by_size[: int(np.searchsorted(-size[by_size], -k, "left"))]
                w, s = won[start[live] + k], state[live]
                s[:, 1:4] = np.stack(glicko_step(s[:, 1], s[:, 2], s[:, 3], w), 1)
                s[:, 0] = elo_step(s[:, 0], w)
                s[:, 4] += 1
                state[live] = s
            keys = [(player[i], surface[i]) for i in start.tolist()]
            if len(keys) > 1:
                yield _told(schema, keys[:-1], state[:-1])
            carried = keys[-1], state[-1]
        if carried:
            yield _told(schema, [carried[0]], carried[1][None])

    sorted_ = rows.repartition("player", "surface").sortWithinPartitions("player", "surface", "at", "result").select("player", "surface", "won")
    out = sorted_.mapInArrow(run, f"player {kind}, surface string, elo double, rating double, rd double, volatility double, matches double")
    whole = F.col("surface") == ""
    deviation = F.round(F.greatest(F.lit(60.0), DEVIATION / F.sqrt(1 + F.col("matches") / 4)), 3)
    return out.select(
        "player", "surface", "elo", F.when(whole, deviation).alias("deviation"), *[F.when(whole, F.col(c)).alias(c) for c in ("rating", "rd", "volatility")], F.col("matches").cast("long").alias("matches")
    )


def _told(schema: pa.Schema, keys: list[tuple], state: np.ndarray) -> pa.RecordBatch:
    first = [pa.array([k[i].as_py() for k in keys], schema.field(i).type) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*first, *(pa.array(state[:, i]) for i in range(len(_STATE)))], names=["player", "surface", *_STATE])
