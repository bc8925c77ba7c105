from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rillspan import api
from rillspan.functions import structs
from rillspan.operators import enrich, grams, search
from rillspan.sources import sinks


def test_geo(spark):
    packets = spark.createDataFrame([("1.0.0.5", "9.9.9.9"), ("fe80::1", "1.0.0.7")], "sip string, dip string")
    ranges = spark.createDataFrame([(0x01000000, 0x010000FF, "DE", "AS1 Net")], "lo long, hi long, cc string, asn string")
    for small in (False, True):
        got = {r.sip: (r.sipcc, r.sipasn, r.dipcc) for r in enrich.with_geo(packets, ranges, small).collect()}
        assert got == {"1.0.0.5": ("DE", "AS1 Net", "--"), "fe80::1": ("--", "--", "DE")}


def test_dns_options(spark):
    rows = [(0, "NOERROR", 1, True, True), (1, "NOERROR", 0, True, True), (2, "NXDOMAIN", 0, True, True), (3, None, None, True, False), (4, "NOERROR", 1, False, True)]
    df = spark.createDataFrame(rows, "n int, rcode string, answers int, q boolean, r boolean")
    kept = lambda **o: [x.n for x in df.filter(enrich.dns_kept(F.col("rcode"), F.col("answers"), F.col("q"), F.col("r"), **o)).collect()]
    assert kept() == [0, 2]
    assert kept(show_noanswer=True) == [0, 2, 3]
    assert kept(only_noanswer=True) == [3]
    assert kept(show_norequest=True) == [0, 2, 4]
    assert kept(only_norequest=True) == [4]
    assert kept(show_all=True) == [0, 1, 2, 3, 4]


def test_foreign_answers(spark):
    answers = F.array(*(F.struct(F.lit("A").alias("type"), F.lit(f"1.1.1.{n}").alias("value"), F.lit(cc).alias("cc"), F.lit(60).alias("ttl")) for n, cc in enumerate(("US", "DE", "--"))))
    row = spark.range(1).select(enrich.answer_line(enrich.foreign_answers(answers)).alias("a"), enrich.answer_line(enrich.foreign_answers(answers, code="US")).alias("b")).first()
    assert tuple(row) == ("A: 1.1.1.1 (DE) (ttl 60s)", "A: 1.1.1.0 (US) (ttl 60s)")


def test_file_activity(spark):
    rows = [(1, 1, "a", 0, 0), (1, 2, None, 5, 0), (1, 3, None, 0, 7), (1, 4, "b", 1, 0)]
    df = spark.createDataFrame(rows, "conn int, n int, file string, rd int, wr int").withColumn("fid", F.lit(9))
    named = enrich.latest_names(df, ["conn"], ["n"], "fid", "file")
    got = {r.file_now: (r.reads, r.writes, r.bytes_read, r.bytes_written, r.mode) for r in enrich.file_activity(named, ["file_now"], F.col("rd") > 0, F.col("wr") > 0, F.col("rd") + F.col("wr")).collect()}
    assert got == {"a": (1, 1, 5, 7, "B"), "b": (1, 0, 1, 0, "R")}


def test_gram_index_loses_nothing(spark):
    rows = [("a", "abcabc"), ("b", "abxbca"), ("c", "ab"), ("d", ""), ("e", "zabcaz")]
    df = spark.createDataFrame(rows, "path string, text string")
    index = grams.build(df)
    for pattern in ("abca", "abc", "ab", "zzz"):
        exact = {r.path for r in search.file_counts(df, pattern).collect()}
        assert {r.path for r in search.file_counts(grams.pruned(df, index, pattern), pattern).collect()} == exact
    assert {r.path for r in grams.pruned(df, index, "abca").collect()} == {"a", "e"}


def test_requests(spark):
    assert api.parse_request(b"0x10\0a\0b\0p\\x00q") == {"kind": "search", "skip": 16, "begin": "a", "end": "b", "pattern": "p\\x00q"}
    assert api.parse_request(b"\0\0\0x")["kind"] == "autocomplete"
    assert api.parse_request(b"010\0\0\0x")["skip"] == 8
    for bad in (b"1\0a\0b", b"-1\0\0\0x", b"z\0\0\0x"):
        with pytest.raises(ValueError):
            api.parse_request(bad)
    rows = [("s", "p1", 1, 0, "cs", 0, "a the b the"), ("s", "p2", 1, 0, "cs", 0, "the")]
    blobs = spark.createDataFrame(rows, "service string, path string, conn int, blob_no int, direction string, start int, data string")
    got = api.answer(blobs, b"1\0\0\0t\\x68e").orderBy("rn").collect()
    assert [(r.path, r.off, r.len, r.raw_len) for r in got] == [("p1", 8, 3, 6), ("p1", 2, 3, 6)]
    assert api.answer(blobs, b"\0p2\0p2\0the").count() == 1


def test_files_and_structs(spark, tmp_path):
    df = spark.createDataFrame([("a/b", b"x", 1), ("a:b", b"yy", 2)], "name string, data binary, n int")
    got = {r.local_name: r.size for r in sinks.write_files(df, f"{tmp_path}/f", order=["n"]).collect()}
    assert got == {"a_b": 1, "a_b_01": 2}
    values, rest = structs.unpack("!HB", ["port", "kind"], b"\x00\x50\x07rest")
    assert values == {"port": 80, "kind": 7} and rest == b"rest"
    assert structs.pack("!HB", ["port", "kind"], values) == b"\x00\x50\x07"
    raw = spark.createDataFrame([(b"\x00\x01\x02\x03",)], "d binary")
    assert raw.select(structs.uint(F.col("d"), 1, 2).alias("x")).first().x == 0x0102
