"""Every query of the engine by name, and the DuckDB SQL that checks it."""

from __future__ import annotations

from . import q_code, q_search, q_shapes, q_text

QUERIES: dict = q_text.QUERIES | q_search.QUERIES | q_code.QUERIES | q_shapes.QUERIES
ORACLES: dict = q_text.ORACLES | q_search.ORACLES | q_code.ORACLES | q_shapes.ORACLES
