"""Training-data operators: extraction, filtering, deduplication, search, encoding, sharding.

Each module holds one operator with a general interface; ``queries.py`` binds the
operators to the given tables and ``oracles.py`` has the SQL that checks them.
Nothing else in the library imports this subpackage.
"""
