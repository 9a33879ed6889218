"""All queries of the library (the training-data operators have their own registry)."""

from . import model_queries, profile_queries, sequence_queries, table_queries

CATALOGUES = (sequence_queries.C, table_queries.C, model_queries.C, profile_queries.C)
QUERIES = {k: q for c in CATALOGUES for k, q in c.queries.items()}
ORACLE = {k: q for c in CATALOGUES for k, q in c.sql.items()}
FLAGSHIP = "flagship"
