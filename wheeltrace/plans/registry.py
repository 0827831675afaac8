"""All queries of the library and their SQL."""

from . import driving, extras, signals

MODULES = (driving, extras, signals)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
