"""Query plans: base views over the given tables, named queries, full analysis."""
