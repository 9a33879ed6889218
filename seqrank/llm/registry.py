"""The subpackage's queries and the SQL that says the same."""

from . import bpe, exact_dedup, lloyd, near_dedup, nn_descent, packing, periodic, quality, quotes, secrets, top_k, url_filter, warc

MODULES = (exact_dedup, bpe, packing, near_dedup, nn_descent, secrets, url_filter, quality, warc, quotes, lloyd, top_k, periodic)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
