"""Training-data operators: one module each, plus the queries that apply them to whole tables.

Nothing else in the package imports this subpackage.
"""
