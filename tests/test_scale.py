"""What must not grow faster than the input: how often a step is run, and what one call holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspan.operators import correlate, tcp
from rillspan.plans import traffic
from rillspan.plans.queries import QUERIES
from rillspan.sources import capture, container
from tests.test_queries import SF


def steps(df) -> dict[str, int]:
    """How often each kind of Python step stands in a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {kind: plan.count(kind) for kind in ("MapInArrow", "MapInPandas", "FlatMapGroupsInPandas")}


def test_smb_traffic_is_parsed_once(spark):
    """Packets, fragments, connections and messages: one step each, and no call for every connection."""
    for name in ("decode_smbfiles", "decode_smb_uploads", "decode_psexec", "smb_pairing"):
        assert steps(QUERIES[name](spark, SF)) == {"MapInArrow": 4, "MapInPandas": 1, "FlatMapGroupsInPandas": 0}


def test_fragments_of_mixed_traffic(spark):
    """Fragments that come late, twice or in other batches; a number used again later; a part that is missing."""
    columns = "file string, frame_no long, ts_us long, sip string, dip string, proto int, ip_id int, frag_offset int, more_fragments boolean, sport int, dport int, payload binary"
    one = lambda n, ts, ip_id, off, more, data, port=1: ("f", n, ts, "a", "b", 17, ip_id, off, more, port if off == 0 else None, 2 if off == 0 else None, data)
    rows = [one(1, 10, 7, 16, False, b"tail"), one(2, 11, 7, 0, True, b"01234567"), one(3, 12, 7, 0, True, b"again..."), one(4, 50_000_000, 7, 0, True, b"abcdefgh"), one(5, 50_000_001, 7, 16, False, b"next"),
            one(6, 20, 8, 0, True, b"lost...."), one(7, 21, 8, 24, False, b"gap"), *(one(100 + k, k, None, 0, False, b"x") for k in range(50))]
    got = tcp.whole(spark.createDataFrame(rows, columns).repartition(7))
    assert sorted(bytes(r.payload) for r in got.filter("frame_no < 100").collect()) == [b"01234567tail", b"abcdefghnext"]
    assert got.filter("frame_no >= 100").count() == 50 and got.columns == [c.split()[0] for c in columns.split(", ")]


def test_connections_are_followed_as_a_stream(spark):
    """Several spells and connections of many pairs, from few partitions."""
    rows = [("f", p * 100 + n, t * 1_000_000 + p, f"h{p}", 5000, "s", 53, 17, None, None, None, bytes([n])) for p in range(40) for n, t in enumerate((0, 10, 100, 110, 300))]
    df = spark.createDataFrame(rows, "file string, frame_no long, ts_us long, sip string, sport int, dip string, dport int, proto int, flags int, seq long, ack long, payload binary")
    found = tcp.connections(df)
    assert steps(found)["FlatMapGroupsInPandas"] == 0
    got = sorted((int(r.client_ip[1:]), r.conn_key.rsplit("|", 1)[1], r.conn_no, bytes(r.data), r.state) for r in found.collect())
    assert got == [(p, k, 0, d, s) for p in range(40) for k, d, s in (("0", b"\0\1", "timeout"), ("1", b"\2\3", "timeout"), ("2", b"\4", "established"))]


def test_announcements_are_not_joined_with_all_of_their_endpoint(spark):
    """An endpoint announced n times that carried n connections made n squared rows."""
    n = 3000
    control = spark.range(n).selectExpr("id AS conn", "'s' AS ip", "5000 AS port", "id * 10 AS ts")
    data = spark.range(n).selectExpr("id AS data_conn", "'s' AS ip", "5000 AS port", "id * 10 + 5 AS ts")
    found = correlate.announced_channel(control, data)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("data_conn = control_conn").count() == n == found.count()
    odd = spark.createDataFrame([(1, None, 5000, 7), (2, "s", 5000, None), (3, "t", 1, 9)], "data_conn long, ip string, port int, ts long")
    assert {r.data_conn: r.control_conn for r in correlate.announced_channel(control, odd).collect()} == {1: None, 2: None, 3: None}


def test_captures_come_in_parts(spark):
    """A file that is cut has the same frames, numbers and connections as a whole one."""
    frames = traffic.http_frames(spark, SF).withColumn("file", F.lit("/c/1.cap"))
    cut, one = capture.as_captures(frames, 20_000), capture.as_captures(frames)
    assert one.count() == 1 < cut.count() and cut.select("path").distinct().count() == 1
    assert max(len(r.content) for r in cut.collect()) < 24_000
    rows = lambda files: sorted((r.file, r.frame_no, r.ts_us, bytes(r.raw)) for r in capture.frames_of(files).collect())
    assert rows(cut) == rows(one) and [r[1] for r in rows(cut)] == list(range(frames.count()))
    whole = lambda files: [bytes(r.content) for r in container.build(files).collect()]
    assert whole(cut) == whole(one)
