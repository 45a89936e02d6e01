"""All registered catalogue queries and their SQL twins."""

from . import catalogue_queries, rule_queries

QUERIES = catalogue_queries.QUERIES | rule_queries.QUERIES
ORACLES = catalogue_queries.ORACLES | rule_queries.ORACLES
