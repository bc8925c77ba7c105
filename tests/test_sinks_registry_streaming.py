from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from rillspan import registry
from rillspan.operators import correlate
from rillspan.sources import config, sinks
from rillspan.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def alerts(spark):
    rows = [("dns", "10.0.0.1", 53, 1.5, "US"), ("web", None, 80, 2.25, None)]
    return spark.createDataFrame(rows, "decoder string, sip string, sport int, ts double, sipcc string")


def test_formats(alerts):
    got = [r.line for r in sinks.text_lines(alerts, "%(decoder)-5s|%(sip)s|%(sport)05d|%(gone)s|100%%", null="-").collect()]
    assert got == ["dns  |10.0.0.1|00053|-|100%", "web  |-|00080|-|100%"]
    lines = [json.loads(r.line) for r in sinks.json_lines(alerts, geo=False).collect()]
    assert lines[0] == {"decoder": "dns", "sip": "10.0.0.1", "sport": 53, "starttime": 1.5}
    extra = sinks.with_extra(alerts, ["decoder", "sip"]).first().extra
    assert extra["sport"] == "53"


def test_writers(spark, alerts, tmp_path):
    sinks.write_csv(alerts, f"{tmp_path}/csv", ["ts:int"], "tab")
    assert spark.read.csv(f"{tmp_path}/csv", sep="\t", header=True).columns == [*sinks.CSV_FIELDS, "ts"]
    sinks.write_json(alerts, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    sinks.write_xml(alerts, f"{tmp_path}/xml")
    assert spark.read.format("xml").option("rowTag", "alert").load(f"{tmp_path}/xml").count() == 2
    registry.write(alerts, "text", f"{tmp_path}/text", "%(decoder)s")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/text").collect()) == ["dns", "web"]
    blobs = spark.createDataFrame([("s", 0, "cs", "ab"), ("s", 1, "sc", "cd"), ("s", 2, "cs", "ef")], "session string, n int, dir string, data string")
    sinks.write_sessions(blobs, f"{tmp_path}/sess", "session", "n", "dir", "data", which="split")
    got = {r.dir: r.value for r in spark.read.text(f"{tmp_path}/sess").collect()}
    assert got == {"cs": "abef", "sc": "cd"}
    with pytest.raises(Exception, match="exists"):
        sinks.write_json(alerts, f"{tmp_path}/json")
    assert "\x1b[31m" in sinks.coloured("cs", b"x") and sinks.coloured("cs", b"<", "html").endswith("&lt;</span>")


def test_config():
    got = config.read_config("[main]\nlimit = 5\nrate=0.5\nname = x\nflag=true\n[grep]\ninvert=false\n")
    assert got == {"main": {"limit": 5, "rate": 0.5, "name": "x", "flag": True}, "grep": {"invert": False}}


def test_chains(spark):
    rows = [(n, "10.0.0.1", 1000, "10.0.0.2", p, 6, 4, None, d) for n, (p, d) in enumerate([(80, "GET secret"), (80, "GET x"), (22, "secret")])]
    df = spark.createDataFrame(rows, "n int, sip string, sport int, dip string, dport int, proto int, version int, vlan int, data string")
    got = registry.run_chain(df, "grep+ip:mine", {"grep": {"expression": "secret"}}, extend="port 80")
    assert [(r.n, r.decoder, r.data) for r in got.collect()] == [(0, "mine", "10.0.0.1 -> 10.0.0.2")]
    assert registry.run_chain(df, "grep", {"grep": {"expression": "secret", "invert": True}}).count() == 1
    assert registry.run_chain(df, "merge", limit=2).count() == 2
    with pytest.raises(ValueError, match="only end"):
        registry.parse_chain("web+grep")
    with pytest.raises(ValueError, match="no option"):
        registry.run_chain(df, "grep", {"grep": {"nope": 1}})
    with pytest.raises(ValueError, match="unknown"):
        registry.parse_chain("nope")
    assert ("dns", "DNS questions and answers", "udp and port 53") in registry.listed()


def test_manifest(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    found = ingest.listing(spark, str(tmp_path))
    manifest = found.filter("path like '%a'").unionByName(spark.createDataFrame([("gone", None, 1)], ingest.MANIFEST))
    assert [r.path[-1] for r in ingest.pending(found, manifest).collect()] == ["b"]
    assert [r.path for r in ingest.vanished(found, manifest).collect()] == ["gone"]
    assert correlate.new_only(found, manifest, ["path"]).count() == 1


def test_watch_and_sessions(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    shutil.copy(f"{SF}/events.parquet", inbox / "1.parquet")
    table = spark.read.parquet(f"{SF}/events.parquet")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.watch(spark, str(inbox), schema, "*.parquet")
        ingest.run_once(stream, lambda df, _: seen.append(df.count()), f"{tmp_path}/ckpt")
    assert sum(seen) == table.count()
    batch = ingest.session_windows(table.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours", size="value")
    assert batch.agg(F.sum("packets")).first()[0] == table.count()


def test_stateful_runs(spark, tmp_path):
    inbox = tmp_path / "in"
    rows = [(1, "cs", "2024-01-01 00:00:00"), (1, "cs", "2024-01-01 00:00:01"), (1, "sc", "2024-01-01 00:00:02"), (2, "cs", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, dir string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(inbox))
    later = spark.createDataFrame([(3, "cs", "2024-01-02 00:00:00")], "user_id long, dir string, ts string").withColumn("ts", F.to_timestamp("ts"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    q = ingest.stream_runs(stream).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        later.coalesce(1).write.mode("append").parquet(str(inbox))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.user_id, r.run, r.dir, r.segments) for r in spark.table("runs").collect())
    assert (1, 1, "cs", 2) in got
