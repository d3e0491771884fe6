from pyspark.sql import functions as F

from conftest import c_peak, h_peak, record
from peakloom.functions import peaks as P
from peakloom.plans.views import spectra

NAN, INF = float("nan"), float("inf")


def test_source_rows_move_and_lists_take_made_structs(spark):
    """The shuffle has only the source columns, and the aggregate only collects."""
    plan = spectra(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression"):]
    assert "l_orderkey" in moved and "array_repeat" not in moved and "CASE" not in moved
    aggregates = [line for line in plan.splitlines() if "collect_list" in line]
    assert aggregates and not any("struct(" in line or "CASE" in line for line in aggregates)


def test_shift_rules_by_the_ends_of_the_list(spark, records):
    lists = [[], None, [1.0], [NAN, 1.0], [1.0, INF], [-INF, 1.0], [None, 1.0], [None], [NAN, 21.0], [-5.0, 20.0], [INF, -5.5], [None, NAN]]
    df = records([record(f"r{i:02d}", h=None if s is None else [h_peak(x, integration=n) for n, x in enumerate(s, 1)], c=[c_peak(0.0)])
                  for i, s in enumerate(lists)])
    h = F.col("h_nmr_peaks")
    rows = df.orderBy("record_id").select(
        P.has_non_finite_shift(h).alias("odd"), P.has_shift_outside(h, -5.0, 20.0).alias("outside"), P.sorted_shifts(h).alias("s"),
        P.has_non_positive_integration(h).alias("none"))
    assert [i for i, r in enumerate(rows.collect()) if r.odd] == [3, 4, 5, 8, 10, 11]
    assert [i for i, r in enumerate(rows.collect()) if r.outside] == [8, 10]
    assert not any(r.none for r in rows.collect()) and [r.s for r in rows.collect()][6] == [None, 1.0]
    assert "lambda" not in df.select(P.has_non_finite_shift(h))._jdf.queryExecution().optimizedPlan().toString()
