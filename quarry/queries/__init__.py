"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from quarry.queries import basic, learning, scalar

QUERIES = {**basic.QUERIES, **scalar.QUERIES, **learning.QUERIES}
ORACLES = {**basic.ORACLES, **scalar.ORACLES, **learning.ORACLES}
