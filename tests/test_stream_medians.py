"""Streamed representative points: against the exact medians, over restarts, with stored batches put together."""

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from wardscore.plans.incidents import COORDINATE_BOUNDS, REPRESENTATIVE, clean_incidents, unit_table
from wardscore.streaming import incident_medians as M
from wardscore.streaming.incident_totals import finished_batches, incident_stream


def table(df):
    return {r.Geo_Unit: r.asDict() for r in df.collect()}


def near(got, want):
    """Totals alike, medians to within half a bucket."""
    assert got.keys() == want.keys()
    for unit, w in want.items():
        g = got[unit]
        for name in ("Incident_Count", "Valid_Point_Count"):
            assert g[name] == w[name]
        assert g["Weighted_Severity_Sum"] == pytest.approx(w["Weighted_Severity_Sum"])
        for raw, name in REPRESENTATIVE.items():
            low, high = COORDINATE_BOUNDS[raw]
            half = (high - low) / M.MEDIAN_BUCKETS / 2 * (1 + 1e-6)
            assert (g[name] is None) == (w[name] is None) and (w[name] is None or abs(g[name] - w[name]) <= half)


@pytest.mark.parametrize("apart", [16, 2])
def test_arriving_files_and_restarts(spark, sf_dir, tmp_path, monkeypatch, apart):
    monkeypatch.setattr(M, "APART", apart)
    events = A.table(spark, sf_dir, "events")
    folder, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    n = 4
    for i in range(n):
        events.where(F.col("event_id") % n == i).coalesce(1).write.mode("append").parquet(folder)
        stream = incident_stream(spark, folder, events.schema, files_per_batch=1)
        M.run_medians(stream, path, state, prepare=A.incidents_of).awaitTermination()
        seen = A.incidents_of(events.where(F.col("event_id") % n <= i))
        near(table(M.latest_medians(spark, path)), table(unit_table(clean_incidents(seen))))
    # Nothing new: nothing changes.
    before = table(M.latest_medians(spark, path))
    M.run_medians(incident_stream(spark, folder, events.schema), path, state, prepare=A.incidents_of).awaitTermination()
    assert table(M.latest_medians(spark, path)) == before
    assert len(finished_batches(spark, path)) <= apart


def test_a_batch_stored_twice_counts_once(spark, sf_dir, tmp_path):
    clean = clean_incidents(A.incidents(spark, sf_dir))
    path = str(tmp_path / "out")
    for _ in range(2):
        M.publish(M.bucket_counts(clean), path, 0)
    near(table(M.latest_medians(spark, path)), table(unit_table(clean)))


def test_units_without_any_point_keep_their_row(spark, sf_dir):
    clean = clean_incidents(A.incidents(spark, sf_dir)).withColumns({n: F.lit(None).cast("double") for n in COORDINATE_BOUNDS})
    got = table(M.medians_of(M.bucket_counts(clean)))
    assert got and all(row[n] is None for row in got.values() for n in REPRESENTATIVE.values())
