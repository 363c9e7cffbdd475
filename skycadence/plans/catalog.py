"""Imports every query module so that ``CATALOG`` is complete."""

from skycadence.plans import (  # noqa: F401
    catalog_anchors,
    catalog_evaluation,
    catalog_features,
    catalog_fits,
    catalog_joins,
    catalog_models,
    catalog_quality,
    catalog_relational,
    catalog_series,
    catalog_streaming,
)
from skycadence.plans.registry import CATALOG  # noqa: F401
