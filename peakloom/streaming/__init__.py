"""Bounded incremental conformance of arriving landing files."""
