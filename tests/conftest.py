import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from peakloom.schema import CANONICAL  # noqa: E402
from peakloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "peakloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def h_peak(shift, **given):
    """A proton peak as a dict with all fields."""
    peak = dict.fromkeys([
        "integration", "multiplicity_raw", "multiplicity", "j_values", "range_min", "range_max",
        "range_half_span", "equivalence_class", "member_shifts"])
    return {"shift": shift, **peak, **given}


def c_peak(shift, **given):
    return {"shift": shift, "integral": None, "intensity": None, "width": None, **given}


def record(record_id, key="CC", h=(), c=(), **given):
    row = dict.fromkeys(CANONICAL.names)
    return {**row, "record_id": record_id, "source": "s", "smiles": key, "smiles_canonical": key,
            "h_nmr_peaks": None if h is None else list(h), "c_nmr_peaks": None if c is None else list(c), **given}


@pytest.fixture
def records(spark):
    return lambda rows: spark.createDataFrame(rows, CANONICAL)
