"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import alignment, language, licences, minhash, mixing, neighbours, packing, pages, sanitising, scoring, spelling, toxicity, vectors

MODULES = (alignment, language, licences, minhash, mixing, neighbours, packing, pages, sanitising, scoring, spelling, toxicity, vectors)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
