"""Queries over the given tables, each a thin use of the operators, with equivalent SQL."""
