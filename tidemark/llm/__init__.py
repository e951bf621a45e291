"""Training-data operators: one module for each, plus their registered queries.

Nothing else in the library imports this package.
"""
