"""Training-data operators: dedup, scoring, packing, search, archives, sharding.

Nothing else in the library imports this subpackage; its queries are
collected in :mod:`weirflow.llm.queries`.
"""
