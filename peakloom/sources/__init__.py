"""Readers, writers and table manifests."""
