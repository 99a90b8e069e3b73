"""The training-data queries by name, and the SQL of those that SQL can express."""

from docketry.llm import chat, exact, language, licences, mixing, near, packing, pii, quality, tokens

_MODULES = (pii, language, near, tokens, packing, exact, chat, licences, mixing, quality)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
