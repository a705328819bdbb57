"""All registered queries; importing the modules registers them."""

from . import aggregates, chances, folds, forecasts, gates, histories, joins, links, live, models, payloads, placing, policies, relational, reports, scalars, scoring, selection, series, settlement, splits, tables, web  # noqa: F401
from ..streaming import feeds  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
