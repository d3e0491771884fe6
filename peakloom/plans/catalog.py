"""Imports every query module, so that all queries are registered."""

from peakloom.plans import (  # noqa: F401
    alignment, augmentation, cleaning, cohorts, conformance, features, hooked, overlaps, pairing, profiling, scans, scoring,
    splits, storage, stores, validation,
)
from peakloom.plans.registry import ORACLE, QUERIES  # noqa: F401
