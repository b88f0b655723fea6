"""Every query by name, with the DuckDB SQL that it must equal where SQL can express it."""

from lumenfold.queries import adaptive, control, integration, observables, panels, streams
from lumenfold.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "adaptive", "control", "integration", "observables", "panels", "streams"]
