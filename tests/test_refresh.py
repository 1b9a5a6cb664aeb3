"""Refreshing by new files only: what is read, what a repeated, failed or anew run leaves."""

import pytest
from pyspark.sql import functions as F

from benchset import adapters as A
from test_stream_medians import near, table
from wardscore.plans import refresh as R
from wardscore.plans.incidents import clean_incidents, incident_points, unit_table


@pytest.fixture
def world(spark, sf_dir, tmp_path):
    events = A.table(spark, sf_dir, "events")
    asked = []

    def read(files):
        asked.append(sorted(files))
        return A.incidents_of(spark.read.schema(events.schema).parquet(*files))

    def add(part, of=5):
        events.where(F.col("event_id") % of == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def check(upto, of=5):
        seen = A.incidents_of(events.where(F.col("event_id") % of <= upto))
        near(table(R.refreshed_units(spark, str(tmp_path / "out"))), table(unit_table(clean_incidents(seen))))
        rows = lambda df: sorted(map(str, df.collect()))
        points = R.refreshed_points(spark, str(tmp_path / "out"))
        assert rows(points) == rows(incident_points(seen).select(*points.columns))

    run = lambda: R.refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), read)
    return add, run, check, asked, tmp_path


def test_only_new_files_are_read(spark, world, monkeypatch):
    monkeypatch.setattr(R, "APART", 2)
    add, run, check, asked, _ = world
    for part in range(4):
        add(part)
        assert run() == 1 and len(asked[-1]) == 1
    assert len({f for files in asked for f in files}) == len(asked) == 4
    check(3)
    assert run() == 0 and len(asked) == 4
    check(3)


def test_a_failed_run_changes_nothing(spark, world, monkeypatch):
    add, run, check, _, _ = world
    add(0)
    run()
    add(1)
    for step in ("bucket_counts", "_set_state"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(R, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            run()
        check(0)
    assert run() == 1
    check(1)


def test_changed_and_gone_files_start_anew(spark, world):
    add, run, check, asked, tmp_path = world
    add(0)
    run()
    add(1)
    run()
    gone = [f for f in (tmp_path / "in").glob("part-*") if asked[-1][0].endswith(f.name)]
    gone[0].unlink()
    assert run() == 1
    check(0)


def test_nothing_read_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        R.refreshed_units(spark, str(tmp_path / "none"))
