"""Compositions of operators: the registered queries and their SQL twins."""
