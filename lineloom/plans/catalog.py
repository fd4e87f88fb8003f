"""All of the library's own queries."""

from __future__ import annotations

from lineloom.plans import evaluation, layout, models, raster, records, registry, relational, text  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
