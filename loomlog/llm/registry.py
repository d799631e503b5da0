"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import decontamination, language, licenses, packing, pii, quality, separators, simhash, token_files, topk

_MODULES = (token_files, language, packing, pii, separators, decontamination, simhash, quality, topk, licenses)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
