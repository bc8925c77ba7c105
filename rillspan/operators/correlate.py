"""Correlation joins: requests with responses, sessions with packets, states as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_by_key(requests: DataFrame, responses: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Full outer pairs of the n-th request and n-th response of a key.

    Unanswered requests and unsolicited responses stay, with nulls.  Columns
    other than the key are prefixed ``q_`` and ``r_``.
    """

    def nth(df: DataFrame, prefix: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        return df.withColumn("n", n).select(*key, "n", *(F.col(c).alias(prefix + c) for c in df.columns if c not in key))

    return nth(requests, "q_").join(nth(responses, "r_"), [*key, "n"], "full_outer")


def pair_following(requests: DataFrame, responses: DataFrame, key: list[str], order: list[str], most: int | None = 1) -> DataFrame:
    """Each response with the latest request of its key that came before it, at most ``most`` for a request.

    Unanswered requests and responses without a request stay, with nulls.
    Columns other than the key are prefixed ``q_`` and ``r_``; ``response_no``
    counts a request's responses from 1.  One shuffle by key.
    """
    names = [c for c in requests.columns if c not in key]

    def side(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*key, F.struct(*(F.col(c) for c in order), F.lit(kind).alias("_kind")).alias("_o"), F.lit(kind).alias("_kind"), F.struct(*names).alias("_m"))

    both = side(requests, 0).unionByName(side(responses, 1))
    upto = Window.partitionBy(*key).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    turn = both.withColumn("_turn", F.count_if(F.col("_kind") == 0).over(upto))
    one = Window.partitionBy(*key, "_turn")
    asked = F.first(F.when(F.col("_kind") == 0, F.col("_m")), ignorenulls=True).over(one)
    marked = turn.withColumns({
        "_q": asked, "_got": F.sum("_kind").over(one), "_no": F.sum("_kind").over(one.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)),
    })
    answer = F.col("_kind") == 1
    keep = F.when(answer, F.lit(True) if most is None else F.col("_q").isNull() | (F.col("_no") <= most)).otherwise(F.col("_got") == 0)
    return marked.filter(keep).select(
        *key, F.when(answer, F.col("_no")).alias("response_no"), *(F.col(f"_q.{c}").alias(f"q_{c}") for c in names),
        *(F.when(answer, F.col(f"_m.{c}")).alias(f"r_{c}") for c in names),
    )


def pair_next(blobs: DataFrame, conn: str, order: str, is_request: Column, columns: list[str]) -> DataFrame:
    """Requests with the blob that follows on the same connection, if that is a response."""
    w = Window.partitionBy(conn).orderBy(order)
    ahead = F.lead(F.struct(is_request.alias("_q"), *columns)).over(w)
    return (
        blobs.withColumn("_next", ahead).filter(is_request)
        .withColumn("_next", F.when(~F.col("_next._q"), F.col("_next")))
        .select(conn, order, *columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))
    )


def pair_left(requests: DataFrame, responses: DataFrame, key: list[str], status: str = "status", missing: int = -1) -> DataFrame:
    """Requests with the response of equal key; without one the status is ``missing``."""
    return requests.join(responses, key, "left").withColumn(status, F.coalesce(status, F.lit(missing)))


def failed_connects(syns: DataFrame, resets: DataFrame) -> DataFrame:
    """Connection attempts that were refused: a reset from the reversed endpoints that acknowledges the attempt.

    ``syns`` and ``resets`` have ``src, sport, dst, dport, seq, ack, ts``; each attempt counts once.
    """
    s, r = syns.alias("s"), resets.alias("r")
    match = (
        (F.col("s.src") == F.col("r.dst")) & (F.col("s.dst") == F.col("r.src"))
        & (F.col("s.sport") == F.col("r.dport")) & (F.col("s.dport") == F.col("r.sport"))
        & (F.pmod(F.col("r.ack") - 1, F.lit(1 << 32)) == F.col("s.seq")) & (F.col("r.ts") >= F.col("s.ts"))
    )
    once = F.row_number().over(Window.partitionBy("s.src", "s.sport", "s.dst", "s.dport", "s.seq").orderBy("s.ts", "r.ts"))
    return s.join(r, match).withColumn("_n", once).filter("_n = 1").select("s.*", F.col("r.ts").alias("reset_ts"))


def tracked(packets: DataFrame, spans: DataFrame, key: list[str], ts: str, start: str = "span_start", stop: str = "span_end") -> DataFrame:
    """Packets that fall in any open span of their key (a left-semi interval join)."""
    p, s = packets.alias("p"), spans.alias("s")
    cond = (F.col(f"p.{ts}") >= F.col(f"s.{start}")) & (F.col(f"p.{ts}") <= F.col(f"s.{stop}"))
    for k in key:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return p.join(s, cond, "left_semi")


def as_of(df: DataFrame, key: list[str], order: list[str], state: Column, name: str) -> DataFrame:
    """Add the latest state that is not null, up to and with each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(state, ignorenulls=True).over(w))


def with_announcements(control: DataFrame, data: DataFrame) -> DataFrame:
    """Rows of both (``_is_data`` tells which) with ``control_conn``: for data the connection that last announced its endpoint, for announcements their own.

    One shuffle by endpoint and a running value: endpoints that are announced
    again and again are not joined with all that they ever carried.
    """
    said = control.withColumns({"control_conn": F.col("conn"), "_is_data": F.lit(0)}).drop("conn")
    both = said.unionByName(data.withColumn("_is_data", F.lit(1)), allowMissingColumns=True)
    known = (F.col("_is_data") == 0) & F.col("ip").isNotNull() & F.col("port").isNotNull() & F.col("ts").isNotNull()
    alone = F.when(F.col("ip").isNull() | F.col("port").isNull(), F.xxhash64(F.to_json(F.struct("control_conn")), *(["data_conn"] if "data_conn" in data.columns else [])))
    upto = Window.partitionBy("ip", "port", alone).orderBy("ts", "_is_data").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(known, F.col("control_conn")), ignorenulls=True).over(upto)
    return both.withColumn("control_conn", F.when(F.col("_is_data") == 0, F.col("control_conn")).otherwise(latest))


def announced_channel(control: DataFrame, data: DataFrame) -> DataFrame:
    """Data connections with the control connection that last announced their endpoint.

    ``control`` has ``conn, ip, port, ts`` (one row per announcement), ``data``
    has ``data_conn, ip, port, ts``; unannounced data connections stay.
    """
    found = with_announcements(control.select("conn", "ip", "port", "ts"), data.select("data_conn", "ip", "port", "ts")).filter("_is_data = 1")
    return found.select("data_conn", "ip", "port", "ts", "control_conn").distinct()


def server_port_streams(requests: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets of a transfer whose server port is chosen late: joined on client endpoint and server address."""
    return requests.join(packets, ["client_ip", "client_port", "server_ip"])


def rebuild_blocks(blocks: DataFrame, key: list[str], block: str, arrival: str, data: str) -> DataFrame:
    """A file from numbered blocks; a block sent again replaces the earlier one."""
    one = blocks.groupBy(*key, block).agg(F.max_by(data, arrival).alias("_d"))
    return one.groupBy(*key).agg(
        F.count("*").alias("n_blocks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(block, "_d"))), lambda x: x["_d"]), "").alias("data"),
    )


def ranges_lookup(rows: DataFrame, ranges: DataFrame, value: str, bits: int = 16, how: str = "left", small: bool = False) -> DataFrame:
    """Rows with the range ``lo..hi`` that holds their value, joined by the value's high bits.

    A range that spans several prefixes is repeated for each, so this is an
    equi-join at any size; ``small`` (a checked size) joins by broadcast instead.
    """
    if small:
        return rows.join(F.broadcast(ranges), (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")), how)
    spread = ranges.withColumn("_p", F.explode(F.sequence(F.shiftright(F.col("lo"), bits), F.shiftright(F.col("hi"), bits))))
    keyed = rows.withColumn("_p", F.shiftright(F.col(value), bits)).alias("l")
    r = spread.alias("r")
    cond = (F.col("l._p") == F.col("r._p")) & (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    return keyed.join(r, cond, how).drop("_p")


def new_only(found: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows not yet in a manifest."""
    return found.join(known, key, "left_anti")
