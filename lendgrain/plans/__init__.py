"""Registered queries over the given tables, each with the SQL that must give the same rows."""

import importlib

MODULES = ("enquiry_queries", "row_queries", "history_queries", "relational_queries", "model_queries", "trade_queries", "category_queries", "bureau_queries")


def load():
    for m in MODULES:
        importlib.import_module(f"lendgrain.plans.{m}")
    from lendgrain.plans import registry
    return registry.QUERIES, registry.ORACLES
