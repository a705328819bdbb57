"""Column expressions on prices and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_vig(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Fair shares of two prices and the margin; (0.5, 0.5, 0) if either is 1 or less or missing."""
    ok = (a > 1) & (b > 1)
    pa, pb = 1 / a, 1 / b
    return (
        F.when(ok, F.round(pa / (pa + pb), 4)).otherwise(0.5),
        F.when(ok, F.round(pb / (pa + pb), 4)).otherwise(0.5),
        F.when(ok, F.round(pa + pb - 1, 4)).otherwise(0.0),
    )


def edge(p: Column, odds: Column) -> Column:
    return p - 1 / odds


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly(p: Column, odds: Column, fraction: float) -> Column:
    """Share of the bank, never negative; 0 for a price of 1 or less."""
    return F.when(odds > 1, F.greatest(F.lit(0.0), (p * odds - 1) / (odds - 1)) * fraction).otherwise(0.0)


def clipped_logit(p: Column, clip: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first failing check in order, empty if all pass; a null check fails."""
    out = None
    for name, failed in checks:
        failed = F.coalesce(failed, F.lit(True))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise("")


def all_reasons(*checks: tuple[str, Column]) -> Column:
    """The names of all failing checks, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(failed, F.lit(True)), F.lit(name)) for name, failed in checks]), lambda x: x.isNotNull())


def set_winner(a: Column, b: Column) -> Column:
    """'a' or 'b' for six games by two, 7-5 or 7-6; null while the set is open."""
    won = lambda x, y: ((x == 6) & (y <= 4)) | ((x == 7) & y.isin(5, 6))
    return F.when(won(a, b), "a").when(won(b, a), "b")
