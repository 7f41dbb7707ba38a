"""All registered queries; importing the modules fills the registry."""

from laketide.plans import (  # noqa: F401
    q_basics,
    q_changes,
    q_features,
    q_growth,
    q_monitoring,
    q_privacy,
    q_products,
    q_quality,
    q_relational,
    q_sources,
    q_streams,
)
from laketide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
