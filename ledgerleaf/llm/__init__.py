"""Training-data operators: one module for each, and the queries that apply them to the given tables."""
