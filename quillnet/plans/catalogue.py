"""All registered queries; importing a plan module registers its queries."""

from quillnet.plans import (  # noqa: F401
    block_plans,
    community_plans,
    distribution_plans,
    edits_plans,
    feature_plans,
    function_plans,
    graph_plans,
    ingest_plans,
    model_plans,
    projection_plans,
    role_plans,
)
from quillnet.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
