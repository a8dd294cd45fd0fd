"""All queries of the graph engine with their SQL."""

from graphloom.plans import algebra, changes, matching

QUERIES = matching.QUERIES | algebra.QUERIES | changes.QUERIES
SQL = matching.SQL | algebra.SQL | changes.SQL
