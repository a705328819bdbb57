"""Bets of an account in order of time, with cash, exposure and settlements that fall due in between."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "account long, bet long, accepted boolean, reason string, stake double, cash double, resets int"


class Account:
    """Cash, open bets (a heap by due time) and how often the account began anew."""

    def __init__(self, initial: float, floor: float):
        self.initial, self.floor, self.cash, self.due, self.resets = initial, floor, initial, [], 0

    def release(self, now) -> None:
        while self.due and self.due[0][0] <= now:
            self.cash += heapq.heappop(self.due)[3]

    def place(self, r, fraction: float, most: float) -> tuple:
        self.release(r.placed)
        exposure = sum(d[4] for d in self.due)
        if self.cash + exposure < self.floor:
            self.cash, self.due, self.resets, exposure = self.initial, [], self.resets + 1, 0.0
        stake = round(fraction * self.cash, 2)
        reason = "price" if not r.odds > 1 else "open_event" if any(d[2] == r.event for d in self.due) else "exposure" if exposure + stake > most * (self.cash + exposure) else "cash" if stake <= 0 else ""
        if not reason:
            self.cash -= stake
            heapq.heappush(self.due, (r.settles, r.bet, r.event, stake * r.odds if r.won else 0.0, stake))
        return r.account, r.bet, not reason, reason, 0.0 if reason else stake, self.cash, self.resets


def simulate(bets: DataFrame, fraction: float = 0.05, most: float = 0.2, initial: float = 1000.0, floor: float = 50.0) -> DataFrame:
    """One row a bet (account, bet, event, placed, settles, odds, won): accepted or the first reason against it.

    Bets due by then are paid first; an event has one open bet; open stakes stay under ``most`` of the bank; a
    bank under ``floor`` begins anew. Rows come sorted to the tasks and are read batch by batch; what is held is the
    current account and its open bets. Bets without account, times or price take no part.
    """
    known = bets.select(
        F.col("account").cast("long").alias("account"), F.col("bet").cast("long").alias("bet"), "event",
        F.unix_micros(F.col("placed").cast("timestamp")).alias("placed"), F.unix_micros(F.col("settles").cast("timestamp")).alias("settles"),
        F.col("odds").cast("double").alias("odds"), F.coalesce("won", F.lit(False)).alias("won"),
    ).where("account is not null and placed is not null and settles is not null and odds is not null")

    def fold(batches):
        key, state = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.account != key:
                    key, state = r.account, Account(initial, floor)
                out.append(state.place(r, fraction, most))
            yield pd.DataFrame(out, columns=["account", "bet", "accepted", "reason", "stake", "cash", "resets"])

    return known.repartition("account").sortWithinPartitions("account", "placed", "bet").mapInPandas(fold, SCHEMA)
