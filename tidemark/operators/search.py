"""Local search over settings: all new neighbours of a step are judged in one pass over a pre-aggregated table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Settings = dict[str, float]
#: A lower loss counts if it is lower by this much.
LEAST_GAIN = 1e-4


def key(settings: Settings) -> str:
    return json.dumps(settings, sort_keys=True)


def grid_neighbours(grid: dict[str, list[float]]) -> Callable[[Settings], list[Settings]]:
    """One step down or up in one setting, in the order of the grid."""

    def around(settings: Settings) -> list[Settings]:
        out = []
        for name, values in grid.items():
            at = values.index(settings[name])
            out += [{**settings, name: values[k]} for k in (at - 1, at + 1) if 0 <= k < len(values)]
        return out

    return around


def better(trial: tuple[float, float], champion: tuple[float, float]) -> bool:
    """A lower log loss, or the same with a lower Brier score."""
    return trial[0] < champion[0] - LEAST_GAIN or (abs(trial[0] - champion[0]) <= 1e-12 and trial[1] < champion[1])


def local_search(first: Settings, neighbours: Callable[[Settings], list[Settings]], evaluate: Callable[[list[Settings]], list[tuple[float, float]]]) -> list[dict]:
    """Every trial in order: step, settings, log_loss, brier, adopted. Ends where no new neighbour is better.

    ``evaluate`` judges a whole frontier at once; no settings are judged twice.
    """
    scores = evaluate([first])
    champion, best = dict(first), scores[0]
    trials, visited, step = [{"step": 0, "settings": champion, "log_loss": best[0], "brier": best[1], "adopted": True}], {key(first)}, 0
    while True:
        frontier = []
        for s in neighbours(champion):
            if key(s) not in visited:
                visited.add(key(s))
                frontier.append(s)
        if not frontier:
            return trials
        step += 1
        got = list(zip(frontier, evaluate(frontier), strict=True))
        good = [(score, k) for k, (_, score) in enumerate(got) if better(score, best)]
        chosen = min(good)[1] if good else None
        trials += [{"step": step, "settings": s, "log_loss": v[0], "brier": v[1], "adopted": k == chosen} for k, (s, v) in enumerate(got)]
        if chosen is None:
            return trials
        champion, best = got[chosen]


def evaluator(counts: DataFrame, grid: dict[str, list[float]], chance: Callable[[dict[str, Column]], Column]) -> Callable[[list[Settings]], list[tuple[float, float]]]:
    """Log loss and Brier score of settings over ``counts`` (y, n and what ``chance`` needs): a frontier, a handful of rows, is joined once."""

    def evaluate(frontier: list[Settings]) -> list[tuple[float, float]]:
        names = list(grid)
        settings = counts.sparkSession.createDataFrame([(k, *[float(s[c]) for c in names]) for k, s in enumerate(frontier)], "trial int, " + ", ".join(f"set_{c} double" for c in names))
        rows = counts.crossJoin(F.broadcast(settings))  # a frontier has two settings for each name at the most
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), chance({c: F.col(f"set_{c}") for c in names})))
        hit = F.col("y") == 1
        loss = F.sum(F.col("n") * -F.ln(F.when(hit, p).otherwise(1 - p))) / F.sum("n")
        brier = F.sum(F.col("n") * F.pow(p - F.col("y"), F.lit(2))) / F.sum("n")
        got = {r.trial: (r.loss, r.brier) for r in rows.groupBy("trial").agg(loss.alias("loss"), brier.alias("brier")).collect()}
        return [got[k] for k in range(len(frontier))]

    return evaluate
