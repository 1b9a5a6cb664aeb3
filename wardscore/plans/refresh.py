"""Incident exports and totals refreshed by what is new: a ledger of the files read, and partial results that add up.

Each run reads only files that the ledger does not know, writes their clean rows and their partial counts as a batch of their own,
and then a state: the list of batches that count, and the files behind them. Readers go by the newest state, a single small file
written last, so a run that fails leaves everything as it was, and one that is repeated finds nothing to do. A file that has
changed or gone makes the next batch start anew from all files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.operators.settle import land
from wardscore.operators.tables import keep_known, order_columns
from wardscore.plans.incidents import POINT_COLUMNS, clean_incidents, totals
from wardscore.sources.tabular import write_table
from wardscore.streaming.incident_medians import KEYS, bucket_counts, medians_of

# So many batches of partial counts are kept apart before the next run puts them together.
APART = 16


def _files(spark: SparkSession, path: str):
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Size and time of change of every data file below a folder, by its path."""
    kind, files = _files(spark, folder)
    found, out = files.listFiles(kind(folder), True), {}
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            out[status.getPath().toString()] = [status.getLen(), status.getModificationTime()]
    return out


def _state(spark: SparkSession, path: str) -> dict:
    """The newest state; an empty one before the first run."""
    kind, files = _files(spark, path)
    folder = kind(f"{path}/state")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return {"number": -1, "points": [], "counts": [], "files": {}}
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/state/{max(numbers)}").collect()))


def _set_state(spark: SparkSession, path: str, state: dict) -> None:
    """Written under another name first: a state is there whole or not at all."""
    kind, files = _files(spark, path)
    draft, final = kind(f"{path}/state/_{state['number']}"), kind(f"{path}/state/{state['number']}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    files.delete(final, True)
    if not files.rename(draft, final):
        raise OSError(f"cannot write the state {final.toString()}")


def refresh(
    spark: SparkSession, source: str, path: str, read: Callable[[list[str]], DataFrame], geo_level: str = "precinct"
) -> int:
    """Bring the export and the totals below ``path`` up to date with the files below ``source``; how many were read.

    ``read`` gives the incidents of a list of files. One run at a time may write to a ``path``.
    """
    now, state = listed(spark, source), _state(spark, path)
    known = state["files"]
    anew = any(now.get(name) != known[name] for name in known)
    fresh = sorted(now if anew else set(now) - set(known))
    if not fresh and not anew:
        return 0
    number = state["number"] + 1
    kept = {"points": [], "counts": []} if anew else {k: list(state[k]) for k in ("points", "counts")}
    if fresh:
        clean = clean_incidents(read(fresh), geo_level)
        points = order_columns(keep_known(clean, POINT_COLUMNS), POINT_COLUMNS)
        write_table(points, f"{path}/points/batch={number}")
        counts = bucket_counts(clean)
        if len(kept["counts"]) >= APART:
            counts = _added(counts.unionByName(_stored(spark, path, "counts", kept["counts"])))
            kept["counts"] = []
        write_table(counts, f"{path}/counts/batch={number}")
        kept = {k: [*v, number] for k, v in kept.items()}
    _set_state(spark, path, {"number": number, **kept, "files": now})
    _clear(spark, path, state, kept)
    return len(fresh)


def _clear(spark: SparkSession, path: str, before: dict, after: dict) -> None:
    """Remove what neither the newest state nor the one before it counts."""
    kind, files = _files(spark, path)
    for name in ("points", "counts"):
        folder = kind(f"{path}/{name}")
        for status in files.listStatus(folder) if files.exists(folder) else []:
            batch = int(status.getPath().getName().rpartition("=")[2])
            if batch not in {*before[name], *after[name]}:
                files.delete(status.getPath(), True)


def _stored(spark: SparkSession, path: str, name: str, batches: list[int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{name}/batch={b}" for b in batches])


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("_n", *totals())])


def refreshed_points(spark: SparkSession, path: str) -> DataFrame:
    """The clean incident rows of all files of the newest state."""
    batches = _state(spark, path)["points"]
    if not batches:
        raise ValueError(f"nothing has been read into {path} yet")
    return _stored(spark, path, "points", batches)


def refreshed_units(spark: SparkSession, path: str) -> DataFrame:
    """Units with totals and representative points, these to within half a bucket, from the stored counts."""
    batches = _state(spark, path)["counts"]
    if not batches:
        raise ValueError(f"nothing has been read into {path} yet")
    return medians_of(land(_added(_stored(spark, path, "counts", batches)), "counts"))
