"""All registered queries and oracles."""

from __future__ import annotations

from workload import aggregates, diagnose, lookups, normalise, streams

QUERIES, ORACLES = {}, {}
for module in (normalise, diagnose, lookups, aggregates, streams):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
FLAGSHIP = diagnose.presence_by_nation
