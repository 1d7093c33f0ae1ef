"""All registered queries."""

from monthloom.plans import boosted, columns, combining, forecasting, learned, learning, refits, storage, summaries  # noqa: F401
from monthloom.plans.registry import ORACLES, QUERIES  # noqa: F401
