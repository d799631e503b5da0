"""All queries of the log engine and their SQL counterparts."""

from loomlog.plans import core, ops

_ALL = [core.R, ops.R]

QUERIES = {k: v for r in _ALL for k, v in r.queries.items()}
ORACLE_SQL = {k: v for r in _ALL for k, v in r.sql.items()}
