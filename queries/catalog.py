"""All registered queries."""

from queries import claims, cohorts, files, labels, spans, training  # noqa: F401
from queries.registry import ORACLES, QUERIES  # noqa: F401
