"""Chances of a game, a tie-break and a match from the score and the serve-point probabilities.

Each table of states is filled once for all rows of an Arrow batch: a cell holds one number a row.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


#: Rows whose tables of states are filled at once.
ROWS = 2_000


def _deuce(p):
    return p * p / (p * p + (1 - p) * (1 - p))


def _game(a: int, b: int, p):
    """The server's chance from a points to b: the wins before deuce, then deuce (negative binomial)."""
    q = 1 - p
    if a >= 3 and b >= 3:
        d = _deuce(p)
        return {0: d, 1: p + q * d, -1: p * d}.get(a - b, np.full_like(p, float(a > b)) if isinstance(p, np.ndarray) else float(a > b))
    need, room = 4 - a, 2 - b
    out = math.comb(6 - a - b, 3 - a) * p ** (3 - a) * q ** (3 - b) * _deuce(p)
    for lost in range(room + 1):
        out = out + math.comb(need - 1 + lost, lost) * p**need * q**lost
    return out


def game_win(a: Column, b: Column, p: Column) -> Column:
    """The same as a column expression: a closed form for each of the 23 scores; points 0 to 3, 4 is advantage."""
    q, d = 1 - p, p * p / (p * p + (1 - p) * (1 - p))
    out = F.when((a >= 3) & (b >= 3), F.when(a == b, d).when(a == b + 1, p + q * d).when(b == a + 1, p * d).otherwise((a > b).cast("double")))
    for x in range(4):
        for y in range(4):
            if x < 3 or y < 3:
                even = math.comb(6 - x - y, 3 - x) * F.pow(p, F.lit(3 - x)) * F.pow(q, F.lit(3 - y)) * d
                for lost in range(3 - y):
                    even = even + math.comb(3 - x + lost, lost) * F.pow(p, F.lit(4 - x)) * F.pow(q, F.lit(lost))
                out = out.when((a == x) & (b == y), even)
    return out


@F.pandas_udf(DoubleType())
def game_win_at(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    """``game_win`` on Arrow batches, for plans that already go through Python."""
    x, y, q = a.to_numpy(int), b.to_numpy(int), p.to_numpy(float)
    out = np.empty(len(q))
    for i, j in {*zip(x.tolist(), y.tolist())}:
        rows = (x == i) & (y == j)
        out[rows] = _game(i, j, q[rows])
    return pd.Series(out)


def tiebreak_table(p_a: np.ndarray, p_b: np.ndarray, first_a: np.ndarray) -> np.ndarray:
    """Chance of side a at each score: [a, b, row]. ``first_a``: side a serves the point at 0-0.

    First to 7 by 2; the serve changes after the first point and after every two. Past 30 the leader wins.
    """
    top = 32
    v = np.zeros((top, top, len(p_a)))
    for a in range(top - 1, -1, -1):
        for b in range(top - 1, -1, -1):
            if ((a >= 7 or b >= 7) and abs(a - b) >= 2) or a > 30 or b > 30:
                v[a, b] = float(a > b)
            else:
                serves = first_a ^ bool((a + b + 1) // 2 % 2)
                p = np.where(serves, p_a, 1 - p_b)
                v[a, b] = p * v[a + 1, b] + (1 - p) * v[a, b + 1]
    return v


def _first_server(serves_a: np.ndarray, played: np.ndarray) -> np.ndarray:
    return serves_a ^ ((played + 1) // 2 % 2).astype(bool)


@F.pandas_udf(DoubleType())
def tiebreak_win(a: pd.Series, b: pd.Series, p_a: pd.Series, p_b: pd.Series, serves_a: pd.Series) -> pd.Series:
    """Chance of side a in a tie-break whose next point ``serves_a`` tells the server of."""
    x, y = a.to_numpy(int), b.to_numpy(int)
    one, two, first = p_a.to_numpy(float), p_b.to_numpy(float), _first_server(serves_a.to_numpy(bool), x + y)
    out = np.empty(len(x))
    for k in range(0, len(x), ROWS):
        r = slice(k, k + ROWS)
        v = tiebreak_table(one[r], two[r], first[r])
        out[r] = v[x[r], y[r], np.arange(v.shape[2])]
    return pd.Series(out)


def _bounded(p):
    return np.clip(p, 0.35, 0.9)


class Match:
    """Chances of side a at game starts, for rows of serve-point probabilities."""

    def __init__(self, p_a: np.ndarray, p_b: np.ndarray, need: int):
        self.p, self.need, self.one = (p_b, p_a), need, np.ones(len(p_a))
        self.hold = (_game(0, 0, p_b), _game(0, 0, p_a))
        self.ties = {s: tiebreak_table(p_a, p_b, np.full(len(p_a), bool(s))) for s in (0, 1)}
        self.at = cache(self._at)

    def next_set(self, sa: int, sb: int, serve: int) -> np.ndarray:
        return self.at(sa, sb, 0, 0, 1 - serve)

    def _at(self, sa: int, sb: int, ga: int, gb: int, serve: int) -> np.ndarray:
        if sa >= self.need or sb >= self.need:
            return self.one * (sa >= self.need)
        if ga == gb == 6:
            t = self.ties[serve][0, 0]
            return t * self.next_set(sa + 1, sb, serve) + (1 - t) * self.next_set(sa, sb + 1, serve)
        if max(ga, gb) >= 6 and abs(ga - gb) >= 2:
            return self.next_set(sa + (ga > gb), sb + (gb > ga), serve)
        return self.after_game(sa, sb, ga, gb, serve, self.hold[serve])

    def after_game(self, sa, sb, ga, gb, serve, held):
        a_wins = held if serve else 1 - held
        return a_wins * self.at(sa, sb, ga + 1, gb, 1 - serve) + (1 - a_wins) * self.at(sa, sb, ga, gb + 1, 1 - serve)


@F.pandas_udf(DoubleType())
def match_win(score: pd.DataFrame) -> pd.Series:
    """Chance of side a; columns sets_a, sets_b, games_a, games_b, points_a, points_b, p_a, p_b, server, need.

    A server that is neither a nor b gives the mean of both. Held within 0.02 and 0.98; a decided match is
    at a bound. Rows of one score are computed together, and tables are filled for distinct chances, ``ROWS``
    of them at a time: they hold some 3,000 numbers each.
    """
    out = np.full(len(score), np.nan)
    score = score.reset_index(drop=True)
    for need, part in score.groupby("need"):
        chances, pair = np.unique(_bounded(part[["p_a", "p_b"]].to_numpy(float)), axis=0, return_inverse=True)
        pair = pair.ravel()
        for k in range(0, len(chances), ROWS):
            here = (pair >= k) & (pair < k + ROWS)
            p = chances[k : k + ROWS]
            _fill(out, part[here], pair[here] - k, Match(p[:, 0], p[:, 1], int(need)))
    return pd.Series(out)


def _fill(out: np.ndarray, part: pd.DataFrame, pair: np.ndarray, m: Match) -> None:
    """Chances of rows of one ``need``; ``pair`` is a row's place in the tables of ``m``."""
    keys = ["sets_a", "sets_b", "games_a", "games_b", "points_a", "points_b", "server"]
    for (sa, sb, ga, gb, pa, pb, server), i in part.groupby(keys, dropna=False).indices.items():
        rows = part.index[i]
        if sa >= m.need or sb >= m.need:
            out[rows] = 0.98 if sa >= m.need else 0.02
            continue
        got = []
        for serve in {"a": (1,), "b": (0,)}.get(server, (1, 0)):
            if ga == gb == 6:
                first = bool(serve) ^ bool((pa + pb + 1) // 2 % 2)
                t = m.ties[int(first)][pa, pb]
                v = t * m.next_set(sa + 1, sb, serve) + (1 - t) * m.next_set(sa, sb + 1, serve)
            elif max(ga, gb) >= 6 and abs(ga - gb) >= 2:
                v = m.at(sa, sb, ga, gb, serve)
            else:
                v = m.after_game(sa, sb, ga, gb, serve, _game(pa, pb, m.p[serve]))
            got.append(v[pair[i]])
        out[rows] = np.clip(np.mean(got, axis=0), 0.02, 0.98)
    m.at = None  # a cycle: with it the tables would stay until the next collection


@cache
def _start_chances(need: int) -> np.ndarray:
    """Side a's chance at 0-0 by its serve-point share in thousandths, 400 to 840; the other side's is 1240 less it."""
    a = np.arange(400, 841)
    m = Match(a / 1000, (1240 - a) / 1000, need)
    return np.clip((m.at(0, 0, 0, 0, 1) + m.at(0, 0, 0, 0, 0)) / 2, 0.02, 0.98)


@F.pandas_udf(ArrayType(DoubleType()))
def serve_shares(p: pd.Series, need: pd.Series) -> pd.Series:
    """The two serve-point shares around 0.62 that give a match chance: 16 halvings."""
    target, three = np.clip(p.to_numpy(float), 0.03, 0.97), need.to_numpy(int) >= 3
    low, high = np.full(len(target), -0.22), np.full(len(target), 0.22)
    for _ in range(16):
        mid = (low + high) / 2
        k = np.rint((0.62 + mid) * 1000).astype(int) - 400
        below = np.where(three, _start_chances(3)[k], _start_chances(2)[k]) < target
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return pd.Series(list(np.stack([0.62 + mid, 0.62 - mid], axis=1)))
