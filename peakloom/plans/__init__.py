"""Registered queries: the operators applied to the shared test tables."""
