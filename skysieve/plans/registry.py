"""All registered domain queries and their SQL."""

from skysieve.plans import more, queries

QUERIES = queries.QUERIES | more.QUERIES
ORACLES = queries.ORACLES | more.ORACLES
