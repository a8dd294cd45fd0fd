"""The queries of this subpackage and their SQL, where SQL can express them."""

from graphloom.llm import jaccard_join, language_id, licenses, mixing, neighbours, packing, pii, quality, secrets, topk

MODULES = (neighbours, packing, mixing, language_id, jaccard_join, quality, licenses, pii, secrets, topk)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
