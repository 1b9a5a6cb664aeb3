"""Streamed zone totals: any arrival order, repeats, restarts and late rows."""

from pyspark.sql import functions as F

from benchset import adapters as A
from wardscore.streaming import zone_totals as Z
from wardscore.streaming.incident_totals import incident_stream


def totals(df):
    return {r.zone_id: (r.Incident_Count, round(r.Weighted_Severity_Sum, 6)) for r in df.collect()}


def test_any_order_within_the_watermark(spark, sf_dir, tmp_path):
    events, zones = A.table(spark, sf_dir, "events"), A.districts(spark, sf_dir)
    folder, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    # Newest first, each file with rows of the one before; a restart between the files.
    for part in (2, 1, 0):
        events.where(F.col("event_id") % 3 >= part).coalesce(1).write.mode("append").parquet(folder)
        stream = incident_stream(spark, folder, events.schema, files_per_batch=1)
        Z.run_zone_totals(stream, zones, "reported", path, state, "3650 days", prepare=A.timed_incidents_of).awaitTermination()
    batch = totals(Z.zone_totals(A.timed_incidents_of(events), zones, "reported"))
    assert totals(Z.latest_zone_totals(spark, path)) == batch
    single = Z.zone_totals(A.timed_incidents_of(events).dropDuplicates(), zones, "reported")
    assert totals(single) == batch


def test_late_rows_are_dropped(spark, sf_dir, tmp_path):
    events, zones = A.table(spark, sf_dir, "events"), A.districts(spark, sf_dir)
    newest = events.agg(F.max("event_id")).first()[0]
    folder, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    early, late = events.where(F.col("event_id") > newest // 2), events.where(F.col("event_id") <= newest // 2)
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = incident_stream(spark, folder, events.schema)
        # A second a row: half the log is far behind the newest row by then.
        Z.run_zone_totals(stream, zones, "reported", path, state, "1 second", prepare=A.timed_incidents_of).awaitTermination()
    assert totals(Z.latest_zone_totals(spark, path)) == totals(Z.zone_totals(A.timed_incidents_of(early), zones, "reported"))


def test_reports_without_a_number_differ_by_their_columns(spark):
    rows = [(None, "a", 1), (None, "a", 1), (None, "b", 1), ("7", "a", 1), ("7", "z", 2), (" ", "a", 1)]
    df = spark.createDataFrame(rows, "CMPLNT_NUM string, what string, t int")
    assert sorted((r.CMPLNT_NUM or "", r.what) for r in Z.once_each(df, "t", "1 day").select("CMPLNT_NUM", "what").collect())[:2] == [("", "a"), ("", "b")]
    assert Z.once_each(df, "t", "1 day").count() == 4
