"""Queries over scalar functions, sinks, requests and streams, each with its DuckDB twin."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F

from rillspan import api, registry
from rillspan.functions import net, protocols, structs
from rillspan.functions import text as txt
from rillspan.operators import filters, grams, search
from rillspan.plans.queries import HITS, query, streams
from rillspan.session import table
from rillspan.sources import config, sinks
from rillspan.streaming import ingest

# ---------------------------------------------------------------- requests and the index


def corpus(spark, sf):
    """Each document is a container of one connection with one blob."""
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    rows = table(spark, sf, "documents").filter("source is not null and text is not null")
    return rows.select(F.col("source").alias("service"), path.alias("path"), F.lit("c").alias("conn"), F.lit(0).alias("blob_no"), F.lit("cs").alias("direction"), F.lit(0).cast("long").alias("start"), F.col("text").alias("data"))


@query(f"""WITH {HITS} SELECT rn, path, off, 3 AS len, 6 AS raw_len FROM (SELECT path, off, row_number() OVER (ORDER BY path DESC, substring(text, off + 1)) AS rn
  FROM h WHERE path BETWEEN 'src1' AND 'src2') WHERE rn > 20 AND rn <= 40""")
def request_search(spark, sf):
    return api.answer(corpus(spark, sf), b"0x14\0src1\0src2\0t\\x68e")


@query(f"""WITH {HITS}, r AS (SELECT path, off, text, row_number() OVER (PARTITION BY path ORDER BY substring(text, off + 1)) - 1 AS rk,
  count(*) OVER (PARTITION BY path) AS c FROM h WHERE path >= 'src1' AND path <= 'src15'),
t AS (SELECT path, off, substring(text, off + 1, 23) AS context FROM r WHERE rk % greatest(c // 20, 1) = 0 ORDER BY path DESC, rk LIMIT 20)
SELECT max(path) AS path, CAST(min(off) AS INT) AS off, context FROM (SELECT *, max(path) OVER (PARTITION BY context) AS mp FROM t) WHERE path = mp GROUP BY context""")
def request_autocomplete(spark, sf):
    return api.answer(corpus(spark, sf), b"\0src1\0src15\0\\164he")


@query(f"""WITH {HITS} SELECT rn, path, off, substring(text, greatest(off - 50, 0) + 1, least(off, 50)) AS before, substring(text, off + 4, 30) AS after FROM (
  SELECT *, row_number() OVER (ORDER BY path DESC, substring(text, off + 1)) AS rn FROM h WHERE path LIKE 'src3/%') WHERE rn <= 20""")
def service_search(spark, sf):
    return api.search(corpus(spark, sf), "the", service="src3").select("rn", "path", "off", "before", "after")


@query("SELECT concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS path, len(string_split(text, 'erthe')) - 1 AS hits FROM documents WHERE contains(text, 'erthe')")
def indexed_count(spark, sf):
    """A search that reads only what the gram index cannot rule out."""
    s = streams(spark, sf)
    return search.file_counts(grams.pruned(s, grams.build(s), "erthe"), "erthe")


# ---------------------------------------------------------------- scalar functions

CODE = "zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA9876543210-_"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@query("SELECT event_id, concat('said ', event_id, ' ', event_type) AS said FROM events")
def base64_alphabets(spark, sf):
    said = F.concat(F.lit("said "), F.col("event_id"), F.lit(" "), F.col("event_type"))
    coded = F.translate(F.base64(F.encode(said, "UTF-8")), PLAIN + "=", CODE + ".")
    return table(spark, sf, "events").select("event_id", F.decode(txt.base64_with(coded, CODE, "."), "UTF-8").alias("said"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '[^ -~\n\r\t]', '.', 'g') AS shown, text AS kept FROM conversations")
def printable_text(spark, sf):
    noisy = F.concat(F.lit("\x01"), F.col("text"), F.lit("\x7f"))
    return table(spark, sf, "conversations").filter(~F.col("text").rlike(r"\p{Cntrl}")).select("conv_id", "turn", txt.printable(F.col("text")).alias("shown"), txt.printable_unicode(noisy).alias("kept")).unionByName(
        table(spark, sf, "conversations").filter(F.col("text").rlike(r"\p{Cntrl}")).select("conv_id", "turn", txt.printable(F.col("text")).alias("shown"), F.col("text").alias("kept"))
    )


@query("SELECT event_id, printf('%08x  %-47s  %s', 0, trim(regexp_replace(lower(hex(encode(concat(event_type, '|', user_id)))), '(..)', '\\1 ', 'g')), concat(event_type, '|', user_id)) AS shown FROM events")
def hex_dumps(spark, sf):
    said = F.encode(F.concat(F.col("event_type"), F.lit("|"), F.col("user_id")), "UTF-8")
    return table(spark, sf, "events").select("event_id", txt.over_bytes(txt.hex_dump)(said).alias("shown"))


@query("""SELECT event_id, '"' || replace(props, '"', '\\"') || '\\x07""b"' AS literal FROM events""")
def c_literals(spark, sf):
    said = F.encode(F.concat(F.col("props"), F.lit("\x07b")), "UTF-8")
    return table(spark, sf, "events").select("event_id", txt.over_bytes(txt.c_literal)(said).alias("literal"))


@query("SELECT event_id, event_type AS word, CAST(user_id AS VARCHAR) AS who, concat('a=', event_id) AS odd FROM events")
def key_value_words(spark, sf):
    said = F.concat(F.lit(" who = "), F.col("user_id"), F.lit(";"), F.col("event_type"), F.lit(" ;; odd=a="), F.col("event_id"))
    got = table(spark, sf, "events").select("event_id", txt.strtok(said).alias("t"))
    return got.select("event_id", F.col("t.words")[0].alias("word"), F.col("t.pairs")["who"].alias("who"), F.col("t.pairs")["odd"].alias("odd"))


@query("SELECT conv_id, turn, md5(text) AS plain_md5 FROM conversations")
def gunzip_bodies(spark, sf):
    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda b: gzip.compress(bytes(b)))

    body = protocols.parsed(protocols.gunzip, "binary")(packed(F.encode("text", "UTF-8")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(body).alias("plain_md5"))


@query("SELECT c_custkey, concat('10.0.', c_custkey // 256, '.', c_custkey % 256) AS ip, CAST((c_custkey % 200) * 256 + c_custkey % 256 AS INT) AS port, CAST(c_custkey % 60000 AS INT) AS extended FROM customer")
def announced_ports(spark, sf):
    c = F.col("c_custkey")
    line = F.concat(F.lit("227 Entering Passive Mode (10,0,"), F.floor(c / 256), F.lit(","), c % 256, F.lit(","), c % 200, F.lit(","), c % 256, F.lit(").\r\n"))
    got = table(spark, sf, "customer").select(c, txt.pasv_endpoint(line).alias("e"), txt.epsv_port(F.concat(F.lit("229 ok (|||"), c % 60000, F.lit("|)"))).alias("extended"))
    return got.select("c_custkey", "e.ip", "e.port", "extended")


@query("""WITH n AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '[/: ]', '_', 'g') AS safe, page_id % 7 AS k FROM pages),
u AS (SELECT page_id, 'file_' || k AS safe FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY page_id) - 1 AS i FROM u)
SELECT page_id, CASE WHEN i = 0 THEN safe ELSE safe || '_' || CASE WHEN i < 10 THEN '0' || i ELSE substring(i::VARCHAR, 1, 2) END END AS local_name FROM r""")
def local_names(spark, sf):
    name = F.concat(F.lit("file:"), F.col("page_id") % 7)
    files = table(spark, sf, "pages").select("page_id", txt.local_filename(name).alias("safe"))
    return txt.unique_filenames(files, "safe", ["page_id"]).select("page_id", "local_name")


@query("SELECT page_id, regexp_replace(url, '[/: ]', '_', 'g') AS safe, md5(html) AS md5, strlen(html) AS size FROM pages WHERE html IS NOT NULL")
def extracted_files(spark, sf):
    pages = table(spark, sf, "pages").filter("html is not null").select("page_id", F.concat("page_id", F.lit("|"), "url").alias("name"), F.encode("html", "UTF-8").alias("data"))
    got = sinks.extracted_files(pages, order=["page_id"])
    return got.select(F.split_part("local_name", F.lit("|"), F.lit(1)).cast("long").alias("page_id"), F.split_part("local_name", F.lit("|"), F.lit(2)).alias("safe"), "md5", "size")


@query("SELECT o_orderkey, o_orderkey % 65536 AS lo, o_custkey % 4294967296 AS hi FROM orders")
def unpacked_fields(spark, sf):
    from rillspan.plans.traffic import num

    data = F.unhex(F.concat(num(F.col("o_orderkey") % 65536, 2), num(F.col("o_custkey"), 4)))
    return table(spark, sf, "orders").select("o_orderkey", structs.uint(data, 0, 2).alias("lo"), structs.uint(data, 2, 4).alias("hi"))


@query("""WITH a AS (SELECT DISTINCT (l_orderkey * 2654435761::HUGEINT % 4294967296)::BIGINT AS ip FROM lineitem)
SELECT ip, CASE WHEN ip // 16777216 IN (10, 127) OR ip // 1048576 = 2753 OR ip // 65536 = 49320 OR ip // 268435456 = 14 THEN ip
  ELSE 167772160 + ('0x' || substring(sha1('key' || ip), 1, 8))::BIGINT % 16777216 END AS mapped FROM a""")
def anonymous_addresses(spark, sf):
    ips = table(spark, sf, "lineitem").select(F.pmod(F.col("l_orderkey") * 2654435761, F.lit(1 << 32)).alias("ip")).distinct()
    return ips.select("ip", net.anonymous_ip(F.col("ip"), "key").alias("mapped"))


@query("""SELECT event_id, sha1(concat('key|', least(a, b), '|', greatest(a, b))) AS flow FROM (SELECT event_id, concat('10.0.0.', user_id % 256, ':', event_id % 1000) AS a, '8.8.8.8:53' AS b FROM events)""")
def anonymous_flows(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("10.0.0."), F.col("user_id") % 256).alias("a"), (F.col("event_id") % 1000).cast("string").alias("ap"), F.lit("8.8.8.8").alias("b"), F.lit("53").alias("bp"))
    turned = F.col("event_id") % 2 == 1
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return e.select("event_id", net.anonymous_flow_ports(side("a", "b"), side("ap", "bp"), side("b", "a"), side("bp", "ap"), "key").alias("flow"))


@query("SELECT event_id, 1000000000 + epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER () AS at FROM events")
def rebased_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    first = e.agg(F.min("s").alias("first"))
    return e.join(F.broadcast(first)).select("event_id", net.rebased(F.col("s"), F.lit(1_000_000_000).cast("long"), F.col("first")).alias("at"))


@query("SELECT c_custkey, 'DOM' AS domain, c_name AS user, c_mktsegment AS host FROM customer")
def ntlm_users(spark, sf):
    from rillspan.plans.traffic import little, size

    wide = lambda c: F.hex(F.encode(c, "UTF-16LE"))
    fields = [wide(F.lit("DOM")), wide(F.col("c_name")), wide(F.col("c_mktsegment"))]
    at, heads = F.lit(64).cast("long"), []
    for f in fields:
        heads.append(F.concat(little(size(f), 2), little(size(f), 2), little(at, 4)))
        at = at + size(f)
    data = F.unhex(F.concat(F.lit("ffff4e544c4d53535000" + "03000000"), F.repeat(F.lit("00"), 16), *heads, F.repeat(F.lit("00"), 12), *fields))
    got = table(spark, sf, "customer").select("c_custkey", protocols.parsed(protocols.ntlm, protocols.NTLM)(data).alias("n"))
    return got.select("c_custkey", "n.domain", "n.user", "n.host")


# ---------------------------------------------------------------- sinks and options


@query("SELECT event_id, concat('events,', event_id, ',10.0.0.1,,,,', user_id, ',', event_type) AS line FROM events")
def csv_alerts(spark, sf):
    rows = table(spark, sf, "events").select(F.lit("events").alias("decoder"), F.col("event_id").cast("string").alias("datetime"), F.lit("10.0.0.1").alias("sip"), "event_id", "user_id", "event_type")
    return sinks.csv_lines(rows, ["user_id:i", "event_type"], keep=["event_id"])


@query("""SELECT conv_id, concat('<alert conv_id="', conv_id, '">', string_agg(concat('<blob turn="', turn, '" role="', role, '"/>'), '' ORDER BY turn), '</alert>') AS line FROM conversations GROUP BY conv_id""")
def xml_alerts(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("_turn"), F.col("role").alias("_role"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("blobs"))
    return sinks.xml_lines(rows, ["conv_id"], "blobs", keep=["conv_id"]).withColumn("line", F.regexp_replace("line", r">\s+<", "><"))


@query("""SELECT conv_id, turn, concat('<span style="color:', CASE WHEN role = 'user' THEN '#c00' ELSE '#080' END, '">', role, ' &lt;', turn, '&gt;</span>') AS shown FROM conversations""")
def coloured_turns(spark, sf):
    said = F.encode(F.concat(F.col("role"), F.lit(" <"), F.col("turn"), F.lit(">")), "UTF-8")
    side = F.when(F.col("role") == "user", "cs").otherwise("sc")
    return table(spark, sf, "conversations").select("conv_id", "turn", sinks.coloured_column(side, said).alias("shown"))


@query("SELECT CAST(event_id AS INT) AS id, epoch_us(ts) AS at_us, props AS p, CAST(user_id AS VARCHAR) AS addr FROM events")
def typed_fields(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sinks.typed_columns(rows, "%(event_id:id)d %(ts:at)timestamp %(props:p)s %(user_id:addr)inet")
    return got.select("id", F.unix_micros("at").alias("at_us"), "p", "addr")


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS value_md5 FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_files(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("direction", F.when(F.col("role") == "user", "cs").otherwise("sc"))
    return sinks.session_texts(rows, "conv_id", "turn", "direction", "text", "cs").select("conv_id", F.md5("value").alias("value_md5"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN '->' WHEN role = 'assistant' THEN '<-' ELSE '--' END AS arrow, CAST(turn AS BIGINT) AS start, text AS said FROM conversations")
def transcripts(spark, sf):
    side = F.when(F.col("role") == "user", "cs").when(F.col("role") == "assistant", "sc").otherwise("other")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", side.alias("d"), F.col("turn").cast("long").alias("start"), F.col("text").alias("said"))
    return sinks.transcript(rows, "conv_id", "turn", "d", "said")


@query("SELECT l_orderkey, CAST(sum(l_quantity) * 8192 AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) * 8192 >= 1.5 * 1048576")
def configured_chain(spark, sf):
    """A decoder with options from an INI text."""
    options = config.read_config("[big]\nsize = 1.5\n[dshell]\ndebug = true\n")
    one = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") * 8192).alias("client_bytes"), F.lit(0).alias("server_bytes"))
    return registry.run_chain(one, "large-flows:big", {"big": options["big"]}).select("l_orderkey", F.col("client_bytes").cast("long").alias("total"))


@query("SELECT l_linenumber + 78 AS port, count(*) AS n FROM lineitem WHERE l_linenumber + 78 IN (80, 81) OR l_orderkey % 100 IN (80, 81) GROUP BY 1")
def either_port(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_linenumber") + 78).alias("port"), (F.col("l_orderkey") % 100).alias("other"))
    return rows.filter(filters.either_port(F.col("port"), F.col("other"), 80, 81)).groupBy("port").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams


def scratch(spark, name: str) -> str:
    """A folder that driver and executors share."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/rillspan/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return ingest.watch(spark, sf, schema, glob="events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS packets FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    """Sessions of an unbounded input, read once to its present end."""
    out = scratch(spark, "stream-sessions")
    windows = ingest.session_windows(event_stream(spark, sf), ["user_id"], "at", "6 hours")
    step = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows")
    q = windows.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", F.unix_micros("start").alias("start_us"), "packets")


@query("""WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'cs' ELSE 'sc' END AS dir FROM events),
g AS (SELECT *, CASE WHEN dir = lag(dir) OVER w THEN 0 ELSE 1 END AS turn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM g),
a AS (SELECT user_id, run, dir, count(*) AS segments, max(run) OVER (PARTITION BY user_id) AS last FROM r GROUP BY user_id, run, dir)
SELECT user_id, run, dir, segments FROM a WHERE run < last""")
def stream_direction_runs(spark, sf):
    """Runs that have ended, from state kept for each key; the run that is still open is not yet told."""
    out = scratch(spark, "stream-runs")
    side = F.when(F.col("event_type").isin("click", "purchase", "signup"), "cs").otherwise("sc")
    runs = ingest.stream_runs(event_stream(spark, sf).withColumn("dir", side).drop("ts").withColumnRenamed("at", "ts"), idle_ms=10**12)
    ingest.run_once(runs, lambda df, n: df.write.mode("append").parquet(f"{out}/rows"), f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("user_id", "run", "dir", "segments")


@query("SELECT 'events.parquet' AS name, true AS pending UNION ALL SELECT 'orders.parquet', false UNION ALL SELECT 'gone.parquet', NULL")
def file_manifest(spark, sf):
    """What a walk over a folder finds against a manifest: new, known and vanished files."""
    found = ingest.listing(spark, sf, glob="{events,orders}.parquet")
    known = found.filter(F.col("path").endswith("orders.parquet"))
    old = known.withColumn("path", F.regexp_replace("path", "orders", "gone"))
    todo = ingest.pending(found, known).select("path", F.lit(True).alias("pending"))
    gone = ingest.vanished(found, known.unionByName(old)).select("path", F.lit(None).cast("boolean").alias("pending"))
    done = known.select("path", F.lit(False).alias("pending"))
    return todo.unionByName(done).unionByName(gone).select(F.substring_index("path", "/", -1).alias("name"), "pending")
