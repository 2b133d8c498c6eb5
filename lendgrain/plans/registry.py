"""Where queries and their SQL are collected."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add
