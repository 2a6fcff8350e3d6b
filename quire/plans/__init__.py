"""Registered queries: the operators applied to tables, with their SQL twins."""
