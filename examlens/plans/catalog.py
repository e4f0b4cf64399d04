"""All registered queries; importing the modules fills the registry."""

from examlens.plans import (  # noqa: F401
    queries_describe,
    queries_forecast,
    queries_panel,
    queries_responses,
    queries_runs,
    queries_sources,
    queries_usage,
)
from examlens.plans.registry import ORACLES, QUERIES  # noqa: F401
