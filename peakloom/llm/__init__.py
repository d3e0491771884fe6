"""Operators for large text collections: classifiers, filters, encodings, search, sharding and cleaning."""
