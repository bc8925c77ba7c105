"""Captures built in the test, through frames, packets, connections and containers."""

from __future__ import annotations

import gzip
import ipaddress
import struct

import pytest

from rillspan.operators import tcp
from rillspan.sources import capture, container

SYN, ACK, FIN, RST = 2, 16, 1, 4


def frame(src, sport, dst, dport, flags=ACK, seq=0, ack=0, data=b"", proto=6, vlan=None):
    if proto == 6:
        body = struct.pack("!HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, ack & 0xFFFFFFFF, 5 << 4, flags, 0, 0, 0) + data
    else:
        body = struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        ip, kind = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0x4000, 64, proto, 0) + a.packed + b.packed, 0x0800
    else:
        ip, kind = struct.pack("!IHBB", 6 << 28, len(body), proto, 64) + a.packed + b.packed, 0x86DD
    tag = struct.pack("!HH", 0x8100, vlan) if vlan else b""
    return bytes(6) + bytes([0, 1, 2, 3, 4, 5]) + tag + struct.pack("!H", kind) + ip + body


C, S = ("10.0.0.1", 1000), ("10.0.0.2", 80)
TALK = [
    frame(*C, *S, SYN, 100), frame(*S, *C, SYN | ACK, 500, 101), frame(*C, *S, ACK, 101, 501),
    frame(*C, *S, ACK, 105, 501, b"World"), frame(*C, *S, ACK, 101, 501, b"Hell"), frame(*C, *S, ACK, 101, 501, b"HELL"),
    frame(*S, *C, ACK, 501, 110, b"answer"), frame(*C, *S, FIN | ACK, 110, 507),
    frame("10.0.0.3", 5, *S, SYN, 1),
    frame("10.0.0.4", 6, *S, ACK, 9, 9, b"no handshake"),
    frame("fe80::1", 7000, "fe80::2", 53, data=b"ask", proto=17), frame("fe80::2", 53, "fe80::1", 7000, data=b"tell", proto=17),
    frame("10.0.0.5", 8, *S, SYN, 1, vlan=7), frame(*S, "10.0.0.5", 8, RST | ACK, 0, 2),
]


def records():
    return [(1_000_000 * n, f) for n, f in enumerate(TALK)]


def test_classic_forms():
    data = capture.write_capture(records())
    assert [(n, ts, raw) for n, ts, _, raw in capture.frames(data)] == [(n, ts, raw) for n, (ts, raw) in enumerate(records())]
    assert len(list(capture.frames(data[:-3]))) == len(TALK) - 1
    big = struct.pack(">IHHIIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 3, 5000, 2, 2) + b"ab"
    assert list(capture.frames(big)) == [(0, 3_000_005, 1, b"ab")]
    with pytest.raises(ValueError):
        capture.frames(b"junk" * 10)


def block(kind, body):
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def test_next_generation_blocks():
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    face = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    packet = block(6, struct.pack("<IIIII", 0, 0, 2_000_001_000, 4, 4) + b"abcd")
    simple = block(3, struct.pack("<I", 4) + b"wxyz")
    unknown = block(0xBAD, b"12345678")
    got = list(capture.frames(section + face + unknown + packet + simple))
    assert got == [(0, 2_000_001, 1, b"abcd"), (1, 0, 1, b"wxyz")]


@pytest.fixture(scope="module")
def blobs_of(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("caps")
    (folder / "one.cap.gz").write_bytes(gzip.compress(capture.write_capture(records())))
    frames = capture.read_frames(spark, str(folder))
    packets = capture.packets(frames).cache()
    return packets, folder


def test_packets(blobs_of):
    packets, _ = blobs_of
    rows = packets.orderBy("frame_no").collect()
    assert len(rows) == len(TALK)
    assert (rows[0].sip, rows[0].sport, rows[0].flags, rows[0].seq) == ("10.0.0.1", 1000, SYN, 100)
    assert (rows[10].version, rows[10].sip, bytes(rows[10].payload)) == (6, "fe80::1", b"ask")
    assert rows[12].vlan == 7 and rows[0].vlan is None


def test_connections(blobs_of):
    packets, _ = blobs_of
    rows = tcp.connections(packets).collect()
    first = sorted((r for r in rows if r.client_ip == "10.0.0.1"), key=lambda r: r.blob_no)
    assert [(r.direction, bytes(r.data), r.state, r.has_gap) for r in first] == [("cs", b"HELLWorld", "closed", False), ("sc", b"answer", "closed", False)]
    assert list(first[0].frames) == [3, 4, 5]
    assert [r.blob_no for r in rows if r.client_ip == "10.0.0.3"] == [None]
    assert not [r for r in rows if r.client_ip == "10.0.0.4"]
    assert [bytes(r.data) for r in rows if r.proto == 17] == [b"ask", b"tell"]
    assert {r.state for r in rows if r.client_ip == "10.0.0.5"} == {"reset"}
    loose = tcp.connections(packets, ignore_handshake=True).collect()
    assert [bytes(r.data) for r in loose if r.client_ip == "10.0.0.4"] == [b"no handshake"]
    got = tcp.connection_records(tcp.connections(packets)).filter("client_ip = '10.0.0.1'").first()
    assert (got.client_packets, got.server_packets, got.client_bytes, got.server_bytes) == (3, 1, 9, 6)


def test_idle_gaps_split(spark):
    rows = [(f"{t}", n, t * 1_000_000, "a", 1, "b", 2, 17, None, None, None, b"x", 0) for n, t in enumerate((0, 10, 100, 110))]
    columns = "ignored string, frame_no long, ts_us long, sip string, sport int, dip string, dport int, proto int, flags int, seq long, ack long, payload binary, frag_offset int"
    df = spark.createDataFrame(rows, columns).selectExpr("*", "'f' AS file")
    got = sorted((r.start_us, bytes(r.data), r.state) for r in tcp.connections(df).collect())
    assert got == [(0, b"xx", "timeout"), (100_000_000, b"xx", "established")]


def test_wrapped_sequence_and_policies():
    top = 2**32 - 2
    assert tcp.laid({top: [b"ab"], 0: [b"cd"]}, top) == (b"abcd", False)
    assert tcp.laid({0: [b"ab"], 4: [b"x"]}, 0) == (b"ab\0\0x", True)
    assert tcp.laid({0: [b"ab"], 4: [b"x"]}, 0, gaps="skip") == (b"abx", True)
    assert tcp.laid({0: [b"abcd"], 2: [b"XYZ"]}, 0) == (b"abcdZ", False)
    assert tcp.laid({0: [b"abcd"], 2: [b"XYZ"]}, 0, overlap=True) == (b"abXYZ", False)
    assert tcp.laid({0: [b"old", b"new"]}, 0, latest=False) == (b"old", False)
    with pytest.raises(ValueError):
        tcp.laid({0: [b"a"], 4: [b"x"]}, 0, gaps="error")


def test_data_source(spark, blobs_of):
    _, folder = blobs_of
    spark.dataSource.register(capture.CaptureSource)
    assert spark.read.format("pcap").load(str(folder)).count() == len(TALK)


def test_select_frames(spark, blobs_of):
    packets, folder = blobs_of
    frames = capture.read_frames(spark, str(folder))
    wanted = packets.filter("sport = 53").select("file", "frame_no")
    assert capture.select_frames(frames, wanted).count() == 1
    assert capture.file_counts(frames).first().packets == len(TALK)


def test_containers(spark, tmp_path):
    one = container.Connection("1.2.3.4", "5.6.7.8", 1000, 80, 77, [("cs", b"GET"), ("sc", b"\0\xff")], [1, 2, 5])
    empty = container.Connection("1.2.3.4", "5.6.7.8", 1001, 80, 78, [("cs", b"")])
    data = container.dump([one, empty, one])
    got = list(container.parse(data))
    assert [c for _, c, _ in got] == [one, one]
    for _, c, starts in got:
        assert [data[s : s + len(x)] for s, (_, x) in zip(starts, c.blobs, strict=True)] == [x for _, x in c.blobs]
    (tmp_path / "a.ap").write_bytes(data)
    rows = container.read_containers(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.conn, r.blob_no, bytes(r.data)) for r in rows] == [(0, 0, b"GET"), (0, 1, b"\0\xff"), (1, 0, b"GET"), (1, 1, b"\0\xff")]
    assert container.export(one, "c") == '/* cs */ "GET",\n/* sc */ "\\x00\\xff",'
    assert container.export(one, "pythonsimple") == "send(b'GET')"
    assert container.export(one, "locconn", 9).startswith("9\t1.2.3.4:1000")
    with pytest.raises(ValueError):
        container.export(one, "nope")


def test_watched_captures(spark, tmp_path):
    folder = tmp_path / "caps"
    folder.mkdir()
    (folder / "a.cap").write_bytes(capture.write_capture(records()))
    seen = []
    stream = capture.packets(capture.watch_frames(spark, str(folder)))
    from rillspan.streaming.ingest import run_once

    run_once(stream, lambda df, _: seen.append(df.count()), f"{tmp_path}/ckpt")
    assert sum(seen) == len(TALK)


def test_anonymised_packets(spark, blobs_of, tmp_path):
    from rillspan.sources import sinks

    packets, _ = blobs_of
    sinks.write_anonymised(packets, str(tmp_path), "key")
    got = spark.read.parquet(f"{tmp_path}/packets")
    assert got.count() == packets.count() and got.columns == packets.columns
    assert not {r.sip for r in got.collect()} & {"fe80::1", "fe80::2"}
    assert spark.read.csv(f"{tmp_path}/mapping", header=True).count() == packets.selectExpr("explode(array(sip, dip)) ip").distinct().count()
