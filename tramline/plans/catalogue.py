"""All queries of the transit library with their SQL, by name."""

from __future__ import annotations

from tramline.plans import aggregates, feeds, joins, journeys, pipelines, providers, scalars, scans, versions, windows  # noqa: F401
from tramline.plans.registry import QUERIES, SQL  # noqa: F401
