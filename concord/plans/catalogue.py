"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from concord.plans import feeds, resolution, scalars

QUERIES: dict = resolution.QUERIES | scalars.QUERIES | feeds.QUERIES
ORACLES: dict[str, str] = resolution.ORACLES | scalars.ORACLES | feeds.ORACLES
