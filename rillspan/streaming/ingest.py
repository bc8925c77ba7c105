"""Continuous ingest: new files against a manifest, and sessions over an unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MANIFEST = "path string, modified timestamp, length long"


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, modified, length`` of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def pending(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks or knows in another state; empty files are never done."""
    known = manifest.filter("length > 0")
    return found.join(known, ["path", "modified", "length"], "left_anti")


def vanished(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries of the manifest whose file is gone."""
    return manifest.join(found.select("path"), "path", "left_anti")


def watch(spark: SparkSession, path: str, schema: str, glob: str = "*", form: str = "parquet", recursive: bool = False) -> DataFrame:
    """Rows of files as they appear; files must be moved into place whole."""
    return (
        spark.readStream.format(form).schema(schema).option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower()).load(path)
    )


def run_once(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there now, exactly once per file, then stop."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def session_windows(stream: DataFrame, key: list[str], ts: str, gap: str = "300 seconds", lateness: str = "5 minutes", size: str | None = None) -> DataFrame:
    """Sessions by idle gap over a stream (or a table), closed once the watermark has passed them."""
    marked = stream.withWatermark(ts, lateness)
    total = [F.sum(size).alias("bytes")] if size else []
    return marked.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("packets"), *total).select(
        *key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", *(["bytes"] if size else [])
    )


RUNS = "user_id long, run long, dir string, segments long, first_us long, last_us long"
STATE = "run long, dir string, segments long, first_us long, last_us long"


def stream_runs(stream: DataFrame, ts: str = "ts", lateness: str = "5 minutes", idle_ms: int = 300_000) -> DataFrame:
    """Direction runs of an unbounded input with ``user_id, dir`` and a timestamp.

    A run is emitted when the direction changes or the key has been idle past
    the watermark; within a batch rows are taken in time order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, dir_, n, first, last = state.get if state.exists else (0, None, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], run, dir_, n, first, last))
            state.remove()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])
            return
        pdf = pd.concat(list(parts)).sort_values(ts)
        for when, side in zip(pdf[ts].astype("datetime64[us]").astype("int64"), pdf["dir"], strict=True):
            if side != dir_:
                if n:
                    out.append((key[0], run, dir_, n, first, last))
                run, dir_, n, first = run + 1, side, 0, when
            n, last = n + 1, when
        state.update((run, dir_, n, int(first), int(last)))
        state.setTimeoutTimestamp(max(int(last) // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])

    marked = stream.select("user_id", "dir", ts).withWatermark(ts, lateness)
    return marked.groupBy("user_id").applyInPandasWithState(step, RUNS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
