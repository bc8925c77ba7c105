"""Sessions, direction runs, reassembly and per-flow aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(packets: DataFrame, key: list[str], ts: str, order: list[str], gap_seconds: float) -> DataFrame:
    """Add ``session``: a running number per key, raised when more than the gap has passed."""
    w = Window.partitionBy(*key).orderBy(*order)
    idle = F.col(ts).cast("double") - F.lag(F.col(ts)).over(w).cast("double")
    start = F.when(idle.isNull() | (idle > gap_seconds), 1).otherwise(0)
    return packets.withColumn("session", F.sum(start).over(w))


def direction_runs(packets: DataFrame, key: list[str], order: list[str], direction: str) -> DataFrame:
    """Add ``run``: a running number per key, raised when the direction changes."""
    w = Window.partitionBy(*key).orderBy(*order)
    turn = F.when(F.lag(direction).over(w).eqNullSafe(F.col(direction)), 0).otherwise(1)
    return packets.withColumn("run", F.sum(turn).over(w))


def flow_counters(packets: DataFrame, key: list[str], ts: str, size: Column, from_client: Column) -> DataFrame:
    """Packets and bytes per direction with start and end, per flow."""
    return packets.groupBy(*key).agg(
        F.count_if(from_client).alias("client_packets"),
        F.count_if(~from_client).alias("server_packets"),
        F.sum(F.when(from_client, size).otherwise(0)).alias("client_bytes"),
        F.sum(F.when(~from_client, size).otherwise(0)).alias("server_bytes"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
    )


def large_flows(flows: DataFrame, size: float = 1.0) -> DataFrame:
    """Flows of at least ``size`` MiB in both directions together; a size that is not positive counts as 1."""
    least = (size if size > 0 else 1) * 1048576
    return flows.filter(F.col("client_bytes") + F.col("server_bytes") >= least)


def long_flows(flows: DataFrame, minutes: float = 5) -> DataFrame:
    """Flows that last at least so many minutes."""
    return flows.filter(F.col("end_time").cast("double") - F.col("start_time").cast("double") >= 60 * minutes)


def half_streams(blobs: DataFrame, conn: str, order: str, direction: str, data: str, glue: str = "") -> DataFrame:
    """Each connection's data per direction, in order."""
    return blobs.groupBy(conn, direction).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda x: x[data]), glue).alias("stream")
    )


def netflow_groups(flows: DataFrame, a: str, b: str, measures: dict[str, Column], first: Column | None = None) -> DataFrame:
    """Group flows by an unordered pair of fields; ``first`` orders rows to name the orientation seen first."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    aggs = [c.alias(n) for n, c in measures.items()]
    if first is not None:
        aggs.append(F.min_by(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), first).alias("orientation"))
    return flows.groupBy(lo.alias("peer_lo"), hi.alias("peer_hi")).agg(*aggs).orderBy("peer_lo", "peer_hi")


SEQUENCE = 1 << 32


def sequence_delta(seq: Column, base: Column) -> Column:
    """Distance of 32-bit sequence numbers from a base, modulo 2^32."""
    return F.pmod(seq - base, F.lit(SEQUENCE))


def reassemble(segments: DataFrame, key: list[str], offset: str, arrival: str, data: str, gaps: str = "pad", fill: str = "\x00", latest: bool = True) -> DataFrame:
    """Contiguous data of each key from segments in any order.

    Of segments at one offset the latest (or first) to arrive wins; where a
    segment reaches over the next one's start, the data already laid stays and
    only its tail is appended.  ``gaps`` is ``pad``, ``skip`` or ``error``.
    """
    if gaps not in ("pad", "skip", "error"):
        raise ValueError("gaps must be pad, skip or error")
    pick = F.max_by if latest else F.min_by
    one = segments.groupBy(*key, offset).agg(pick(data, arrival).alias("_d"))
    laid = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(offset).cast("long").alias("o"), F.col("_d").alias("d")))).alias("_s"))
    start = F.struct(F.col("_s")[0]["o"].alias("at"), F.lit("").alias("out"), F.lit(False).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        lack = x["o"] - acc["at"]
        hole = lack > 0
        filler = F.repeat(F.lit(fill), F.greatest(lack, F.lit(0)).cast("int")) if gaps == "pad" else F.lit("")
        tail = F.substring(x["d"], (F.greatest(-lack, F.lit(0)) + 1).cast("int"), F.length(x["d"]))
        return F.struct(
            F.greatest(acc["at"], x["o"] + F.length(x["d"])).alias("at"),
            F.concat(acc["out"], F.when(hole, filler).otherwise(F.lit("")), tail).alias("out"),
            (acc["gap"] | hole).alias("gap"),
        )

    done = laid.withColumn("_r", F.aggregate("_s", start, step))
    if gaps == "error":
        done = done.withColumn("_r", F.when(F.col("_r.gap"), F.raise_error(F.lit("a segment is missing"))).otherwise(F.col("_r")))
    return done.select(*key, F.col("_r.out").alias("data"), F.col("_r.gap").alias("has_gap"))


def defragment(fragments: DataFrame) -> DataFrame:
    """IPv4 payloads from ``src, dst, id, frag_offset, more, data``; complete ones only."""
    keyed = fragments.dropDuplicates(["src", "dst", "id", "frag_offset"]).groupBy("src", "dst", "id").agg(
        F.array_sort(F.collect_list(F.struct("frag_offset", "data", "more"))).alias("s"),
    )
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: F.when(x["frag_offset"] == a, a + F.length(x["data"])).otherwise(F.lit(-1).cast("long")))
    return keyed.filter((total >= 0) & ~F.element_at("s", -1)["more"]).select(
        "src", "dst", "id", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data")
    )


def range_coverage(ranges: DataFrame, key: list[str], start: str, stop: str) -> DataFrame:
    """Merged intervals per key: ``covered, gaps, first, last``."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    upto = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_gap", F.greatest(F.col(start) - upto, F.lit(0))).withColumn("_gap", F.coalesce("_gap", F.lit(0)))
    span = F.max(stop) - F.min(start)
    return marked.groupBy(*key).agg(
        F.min(start).alias("first"), F.max(stop).alias("last"), F.sum("_gap").alias("gaps"), (span - F.sum("_gap")).alias("covered")
    )


def hex_offsets(blobs: DataFrame, conn: str, order: str, direction: str, data: str) -> DataFrame:
    """Add ``hex_offset``: bytes of the same direction before each blob."""
    w = Window.partitionBy(conn, direction).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blobs.withColumn("hex_offset", F.coalesce(F.sum(F.length(data)).over(w), F.lit(0)).cast("long"))
