from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from rillspan.functions import bpf, net, protocols, text
from rillspan.functions.patterns import escape, escape_column
from rillspan.operators import correlate, filters, flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_addresses(spark):
    assert one(spark, net.ip_to_int(F.lit("10.1.2.3"))) == 0x0A010203
    assert one(spark, net.ip_to_int(F.lit("10.1.2.300"))) is None
    assert one(spark, net.int_to_ip(F.lit(0x0A010203))) == "10.1.2.3"
    assert one(spark, net.protocol_name(F.lit(58))) == "ICMP6"
    assert one(spark, net.anonymous_ip(F.lit(0x0A010203), "k")) == 0x0A010203
    mapped = one(spark, net.anonymous_ip(F.lit(0x08080808), "k"))
    assert 0x0A000000 <= mapped <= 0x0AFFFFFF
    mac = one(spark, net.anonymous_mac(F.lit("00:11:22:33:44:55"), "k"))
    assert int(mac[:2], 16) & 3 == 2 and len(mac) == 17
    a, b = (net.anonymous_flow_ports(*map(F.lit, x), "k") for x in (("a", 1, "b", 2), ("b", 2, "a", 1)))
    assert one(spark, a) == one(spark, b)


def test_low_port_swap(spark):
    df = spark.createDataFrame([("a", 53, "b", 4000)], "src string, sport int, dst string, dport int")
    assert tuple(net.low_port_swap(df).first()) == ("b", 4000, "a", 53)


def test_text(spark):
    assert one(spark, text.url_parameters(F.lit("a=1&b=x%20y"))) == {"a": "1", "b": "x y"}
    assert one(spark, text.url_parameters(F.lit("a b=1"))) is None
    assert one(spark, text.cookies(F.lit("k=v; s=%41"))) == {"k": "v", "s": "A"}
    heads = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("Via", "a"), ("VIA", "b"), ("Date", "Tue, 15 Nov 1994 08:12:31 GMT"))))
    assert one(spark, text.header(heads, "via")) == "a, b"
    assert one(spark, text.header(heads, "host")) == ""
    assert str(one(spark, text.last_modified(heads))) == "1994-11-15 08:12:31"
    assert one(spark, text.truncated(F.lit("abcdef"), 3)) == "abc[truncated]"
    assert one(spark, text.payload_md5(F.lit("ab\x00\x00"))) == hashlib.md5(b"ab").hexdigest()
    assert tuple(one(spark, text.pasv_endpoint(F.lit("227 ok (10,0,0,1,4,2)")))) == ("10.0.0.1", 1026)
    assert one(spark, text.epsv_port(F.lit("229 (|||5000|)"))) == 5000
    assert one(spark, text.local_filename(F.lit("a/b:c\x01"))) == "a_b_c%01"
    assert text.xor_bytes(b"abc", b"\x01\x02") == b"`" + b"`" + b"b"
    assert text.c_literal(b'a"\x01f') == '"a\\"\\x01""f"'
    assert text.hex_dump(b"AB\x00", 2, 16).splitlines()[0].startswith("00000010  41 42")
    part = F.lit('--x\r\nContent-Disposition: form-data; name="f"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\nhello\r\n--x--')
    assert tuple(one(spark, text.multipart_file(part))) == ("text/plain", "a.txt", "hello")
    raw = bytes(range(256))
    assert one(spark, escape_column(F.decode(F.lit(raw), "ISO-8859-1"))) == escape(raw)
    assert bytes(one(spark, text.base64_with(F.lit("-_8*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "*"))) == b"\xfb\xff"


def test_unique_filenames(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, k int")
    got = {r.k: r.local_name for r in text.unique_filenames(df, "n", ["k"]).collect()}
    assert got == {1: "a", 2: "a_01", 3: "b"}


PACKETS = [
    ("10.0.0.1", 1000, "10.0.0.2", 80, 6, 4, None), ("10.0.0.2", 80, "10.0.0.1", 1000, 6, 4, 7),
    ("8.8.8.8", 53, "10.0.0.1", 5353, 17, 4, None), ("10.0.0.3", None, "10.0.0.1", None, 1, 4, None),
]


@pytest.mark.parametrize(("expr", "want"), [
    ("", [0, 1, 2, 3]), ("tcp", [0, 1]), ("udp and port 53", [2]), ("tcp and (port 80 or port 8080)", [0, 1]),
    ("src port 80", [1]), ("not tcp", [2, 3]), ("host 10.0.0.3", [3]), ("src net 8.0.0.0/8 or icmp", [2, 3]),
    ("vlan", [1]), ("tcp dst port 80", [0]), ("portrange 50-100 and udp", [2]),
])
def test_bpf(spark, expr, want):
    rows = [(n, *p) for n, p in enumerate(PACKETS)]
    df = spark.createDataFrame(rows, "n int, sip string, sport int, dip string, dport int, proto int, version int, vlan int")
    assert sorted(r.n for r in df.filter(bpf.compiled(expr)).collect()) == want


def test_bpf_text():
    assert bpf.combined("tcp", extend="or udp", vlan=False) == "(tcp) or udp"
    assert bpf.combined("tcp") == "(tcp) or (vlan and (tcp))"
    assert bpf.read_expression("tcp # web\nand port 80") == "tcp and port 80"
    for bad in ("tcp and", "(tcp", "tcp )"):
        with pytest.raises(ValueError):
            bpf.compiled(bad)


def test_rules_try_every_occurrence(spark):
    rules = filters.parse_rules('''
    alert ip any any -> any any (content:"the"; content:"and"; distance:0; within:6;)
    alert ip any any -> any any (content:"A."; nocase; content:"b"; distance:1; within:2; content:"c"; within:1;)
    alert ip any any -> any any (content:"ab"; content:"long"; within:3;)
    ''')
    rows = [(0, "the ......... the\nand"), (1, "the ......... the ...and"), (2, "a.-b a.-bc"), (3, "a.-b A..--bc"), (4, "ablong"), (5, None)]
    df = spark.createDataFrame(rows, "n int, data string")
    assert [[r.n for r in df.filter(filters.rule_predicate(x)).collect()] for x in rules] == [[0], [2], []]
    assert df.filter(filters.rule_predicate(rules[0], first_only=True)).count() == 0


def test_rules(spark):
    rules = filters.parse_rules('''
    alert tcp any any -> any 80 (msg:"a"; content:"ab|20 63|"; offset:1; depth:6;)
    alert ip !10.0.0.1 any -> any 1:100 (content:"GET"; nocase; content:"x"; distance:1; within:3;)
    ''')
    rows = [(0, "tcp", "10.0.0.9", 1, "h", 80, "zab c"), (1, "tcp", "10.0.0.9", 1, "h", 80, "ab c"), (2, "udp", "10.0.0.9", 1, "h", 50, "get--x"), (3, "udp", "10.0.0.1", 1, "h", 50, "get--x"), (4, "udp", "h", 1, "h", 50, "get-----x")]
    df = spark.createDataFrame(rows, "n int, proto string, sip string, sport int, dip string, dport int, data string")
    hits = [[r.n for r in df.filter(filters.rule_predicate(x)).collect()] for x in rules]
    assert hits == [[0], [2]]
    assert [r.n for r in filters.apply_rules(df, [filters.rule_predicate(x) for x in rules], "none").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        filters.parse_rule("drop everything")


def test_country_modes(spark):
    rows = [("US", "US"), ("US", "DE"), ("DE", "US"), ("DE", None)]
    df = spark.createDataFrame(rows, "c string, s string")
    label = lambda **o: [r[0] for r in df.select(filters.country_label(F.col("c"), F.col("s"), "US", **o)).collect()]
    assert label() == ["client", "client", "server", None]
    assert label(neither=True) == [None, None, None, "neither"]
    assert label(both=True) == ["both", None, None, None]
    assert label(not_both=True) == [None, "notboth", "notboth", None]


def test_reassembly(spark):
    rows = [(1, 6, 0, "defg"), (1, 0, 1, "abc"), (1, 0, 2, "ABC"), (1, 2, 3, "cde"), (2, 0, 0, "xy"), (2, 4, 1, "z")]
    df = spark.createDataFrame(rows, "k int, off long, n int, d string")
    got = {r.k: (r.data, r.has_gap) for r in flows.reassemble(df, ["k"], "off", "n", "d", fill=".").collect()}
    assert got == {1: ("ABCde.defg", True), 2: ("xy..z", True)}
    skipped = {r.k: r.data for r in flows.reassemble(df, ["k"], "off", "n", "d", gaps="skip").collect()}
    assert skipped[2] == "xyz"


def test_defragment(spark):
    rows = [("a", "b", 1, 3, False, b"def"), ("a", "b", 1, 0, True, b"abc"), ("a", "b", 2, 0, True, b"abc")]
    df = spark.createDataFrame(rows, "src string, dst string, id int, frag_offset int, more boolean, data binary")
    assert [(r.id, bytes(r.data)) for r in flows.defragment(df).collect()] == [(1, b"abcdef")]


def test_thresholds_are_inclusive(spark):
    rows = [(1, 1048576, 0, 0, 300), (2, 1048575, 0, 0, 299)]
    df = spark.createDataFrame(rows, "k int, client_bytes long, server_bytes long, s long, e long")
    df = df.withColumn("start_time", F.timestamp_seconds("s")).withColumn("end_time", F.timestamp_seconds("e"))
    assert [r.k for r in flows.large_flows(df).collect()] == [1]
    assert [r.k for r in flows.long_flows(df).collect()] == [1]


def test_range_lookup(spark):
    ranges = spark.createDataFrame([(0, 99, "a"), (65000, 200000, "b")], "lo long, hi long, cc string")
    rows = spark.createDataFrame([(5,), (100,), (66000,), (150000,)], "ip long")
    for small in (False, True):
        got = {r.ip: r.cc for r in correlate.ranges_lookup(rows, ranges, "ip", small=small).collect()}
        assert got == {5: "a", 100: None, 66000: "b", 150000: "b"}


def test_announced_channel(spark):
    control = spark.createDataFrame([("c1", "h", 20, 1), ("c2", "h", 20, 5)], "conn string, ip string, port int, ts int")
    data = spark.createDataFrame([("d1", "h", 20, 3), ("d2", "h", 20, 9), ("d3", "h", 21, 9)], "data_conn string, ip string, port int, ts int")
    got = {r.data_conn: r.control_conn for r in correlate.announced_channel(control, data).collect()}
    assert got == {"d1": "c1", "d2": "c2", "d3": None}


def dns_message(id_, name, answers=(), response=True, code=0):
    q = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack("!HH", 1, 1)
    body = b"".join(b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes(map(int, a.split("."))) for a in answers)
    return struct.pack("!HHHHHH", id_, (0x8000 if response else 0) | code, 1, len(answers), 0, 0) + q + body


def test_dns(spark):
    got = protocols.dns(dns_message(7, "a.example", ["1.2.3.4", "5.6.7.8"]))
    assert (got["id"], got["qname"], [a["value"] for a in got["answers"]]) == (7, "a.example", ["1.2.3.4", "5.6.7.8"])
    assert protocols.dns(dns_message(7, "x.y", code=3))["rcode"] == "NXDOMAIN"
    df = spark.createDataFrame([(dns_message(1, "h.example", ["9.9.9.9"]),), (b"\x00",)], "raw binary")
    rows = df.select(protocols.parsed(protocols.dns, protocols.DNS)("raw").alias("m")).select(protocols.dns_line(F.col("m"), F.col("m.answers"), F.col("m.rcode")).alias("l")).collect()
    assert rows[0].l == "A? h.example / A: 9.9.9.9 (ttl 60s)" and rows[1].l is None
    assert one(spark, protocols.looks_tunnelled(F.lit("TXT"), F.lit("ABC1.x.y"), F.lit("aGVsbG8="))) is True
    assert one(spark, protocols.looks_tunnelled(F.lit("TXT"), F.lit("abc.x.y"), F.lit("aGVsbG8="))) is False


def test_http():
    got = protocols.http(b"GET /a?b=1 HTTP/1.1\r\nHost: h\r\nX: 1\r\n 2\r\n\r\n")
    assert (got["method"], got["uri"], got["headers"][1]["value"]) == ("GET", "/a?b=1", "1 2")
    got = protocols.http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")
    assert (got["status"], got["body"]) == (200, b"abcde")
    with pytest.raises(ValueError):
        protocols.http(b"junk")
    assert protocols.gunzip(b"junk") is None


def test_ftp():
    lines = [("cs", "USER u"), ("sc", "331"), ("cs", "PASS p"), ("sc", "230"), ("cs", "CWD pub"), ("sc", "250"), ("cs", "CWD no"), ("sc", "550"), ("cs", "RETR f.txt")]
    nowhere = {"ip": None, "port": None, "at": None}
    assert protocols.ftp_fold(lines) == [{"command": "RETR", "file": "f.txt", "path": "/pub", "user": "u", "password": "p"} | nowhere]
    lines = [("sc", "227 ok (10,0,0,1,4,2)", 7), ("cs", "STOR a", 8), ("sc", "229 ok (|||99|)", 9), ("cs", "RETR b", 10)]
    assert [(t["ip"], t["port"], t["at"]) for t in protocols.ftp_fold(lines)] == [("10.0.0.1", 1026, 7), ("10.0.0.1", 99, 9)]


def test_tftp_dhcp():
    assert protocols.tftp(b"\0\1name\0octet\0")["file"] == "name"
    assert protocols.tftp(b"\0\3\0\7data")["data"] == b"data"
    assert protocols.tftp(b"\0\5\0\1gone\0")["error"] == 1
    head = bytes([1, 1, 6, 0]) + struct.pack("!I", 0xABCD) + bytes(228) + b"\x63\x82\x53\x63"
    got = protocols.dhcp(head + b"\x35\x01\x01\x0c\x02pc\x3d\x07\x01\x00\x11\x22\x33\x44\x55\xff")
    assert (got["xid"], got["hostname"], got["client_mac"]) == ("0x0000abcd", "pc", "00:11:22:33:44:55")
    assert protocols.dhcp(head + b"\xff")["hostname"] is None


def smb_message(command, words=b"", data=b"", response=False, mid=1):
    flags = 0x80 if response else 0
    return b"\xffSMB" + bytes([command]) + struct.pack("<IBH", 0, flags, 0) + bytes(12) + struct.pack("<HHHH", 1, 2, 3, mid) + bytes([len(words) // 2]) + words + struct.pack("<H", len(data)) + data


def test_smb():
    stream = b"".join(struct.pack("!I", len(m)) + m for m in (smb_message(4, struct.pack("<HI", 9, 0)), smb_message(0x2F)))
    found = [protocols.smb(m) for m in protocols.smb_messages(stream)]
    assert [m["command"] for m in found] == [4, 0x2F] and protocols.smb_fid(found[0]) == 9
    assert protocols.netbios_length(b"\0\1\2\3") == 0x10203
    words = struct.pack("<BBHHIIHHHHH", 255, 0, 0, 5, 64, 0, 0, 0, 0, 3, 35 + 24) + bytes(0)
    words = words.ljust(24, b"\0")
    assert protocols.smb_write(protocols.smb(smb_message(0x2F, words, b"abc"))) == (64, b"abc")
    name = "a.txt".encode("utf-16-le")
    assert protocols.smb_filename(protocols.smb(smb_message(0xA2, bytes(48), name))) == "a.txt"
    texts = [x.encode("utf-16-le") for x in ("DOM", "user", "host")]
    at, table = 64, b""
    for t in texts:
        table += struct.pack("<HHI", len(t), len(t), at)
        at += len(t)
    raw = (b"NTLMSSP\0\x03\0\0\0" + bytes(16) + table).ljust(64, b"\0") + b"".join(texts)
    assert protocols.ntlm(b"xx" + raw) == {"domain": "DOM", "user": "user", "host": "host"}
