"""The registered queries over the sample tables, each with its DuckDB twin.

``documents`` stand in for stream files (path = source/doc_id), ``conversations``
for connections with blobs, ``events`` for packets, ``orders`` with ``lineitem``
for flows, ``nation`` for the geographic dimension, ``pages`` for responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspan.functions import net, text as txt
from rillspan.functions.patterns import escape_column
from rillspan.operators import correlate, filters, flows, search
from rillspan.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- views of the tables

DOCS = "d AS (SELECT concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS path, * FROM documents)"
HITS = f"""{DOCS}, p AS (
  SELECT path, text, unnest(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) AS k FROM d),
h AS (SELECT path, text, k, CAST(sum(length(part)) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  + 3 * (k - 2) AS INT) AS off FROM p QUALIFY k > 1)"""
EVENTS = """e AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'cs' ELSE 'sc' END AS dir FROM events)"""


def streams(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return table(spark, sf, "documents").select(path.alias("path"), "text")


def events(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("click", "purchase", "signup"), "cs").otherwise("sc")
    return table(spark, sf, "events").withColumn("dir", side).withColumn("at", F.col("ts").cast("timestamp"))


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    return search.container_offsets(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item with the customer's and the supplier's nation."""
    nation = table(spark, sf, "nation")
    client = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("client"))
    server = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("server"))
    return (
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(client, "c_nationkey").join(server, "s_nationkey")
    )


SHIPMENTS = """s AS (SELECT l.*, nc.n_name AS client, ns.n_name AS server FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey)"""

# ---------------------------------------------------------------- search


@query(f"WITH {DOCS} SELECT path, len(string_split(text, 'the')) - 1 AS hits FROM d WHERE contains(text, 'the')")
def substring_count(spark, sf):
    return search.file_counts(streams(spark, sf), "the")


@query(f"WITH {HITS} SELECT path, off FROM h")
def substring_locate(spark, sf):
    return search.locate(streams(spark, sf), "the")


PAGE = """SELECT rn, path, off, 3 AS len FROM (SELECT path, off, row_number() OVER (
  ORDER BY path DESC, substring(text, off + 1)) AS rn FROM h {where}) WHERE rn > {skip} AND rn <= {skip} + 20"""


@query(f"WITH {HITS} {PAGE.format(where='', skip=20)}")
def search_page(spark, sf):
    return search.search(streams(spark, sf), "the", *search.page_of(1))


@query(f"WITH {HITS} {PAGE.format(where="WHERE path BETWEEN 'src1/' AND 'src12/99999999'", skip=0)}")
def search_file_range(spark, sf):
    return search.search(streams(spark, sf), "the", begin="src1/", end="src12/99999999")


@query(f"""WITH {HITS}, c AS (SELECT path, count(*) AS n FROM h GROUP BY path),
v AS (SELECT n, coalesce(sum(n) OVER (ORDER BY path DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT CAST(sum(n) AS BIGINT) AS total FROM v WHERE greatest(before - 40, 0) < 20""")
def search_total_visited(spark, sf):
    return search.search_total(streams(spark, sf), "the", 40, 20)


@query(f"""WITH {HITS}, r AS (SELECT path, off, text, row_number() OVER (PARTITION BY path ORDER BY substring(text, off + 1)) - 1 AS rk,
  count(*) OVER (PARTITION BY path) AS c FROM h),
t AS (SELECT path, off, substring(text, off + 1, 23) AS context FROM r WHERE rk % greatest(c // 20, 1) = 0 ORDER BY path DESC, rk LIMIT 20)
SELECT max(path) AS path, CAST(min(off) AS INT) AS off, context FROM (
  SELECT *, max(path) OVER (PARTITION BY context) AS mp FROM t) WHERE path = mp GROUP BY context""")
def autocomplete(spark, sf):
    return search.autocomplete(streams(spark, sf), "the")


@query("""WITH p AS (SELECT conv_id, turn, text, unnest(string_split(text, 'the')) AS part,
  generate_subscripts(string_split(text, 'the'), 1) AS k FROM conversations),
h AS (SELECT conv_id, text, k, sum(length(part)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  + 3 * (k - 2) AS off FROM p QUALIFY k > 1)
SELECT DISTINCT conv_id AS path, substring(text, CAST(off AS BIGINT) + 1, 23) AS context FROM h""")
def autocomplete_trimmed(spark, sf):
    parts = blobs(spark, sf)
    each = parts.select(F.concat_ws("/", "conv_id", "turn").alias("path"), "conv_id", "start", "text")
    hits = search.locate(each, "the", keep=("conv_id", "start")).select(
        F.col("conv_id").alias("path"), (F.col("start") + F.col("off")).alias("off")
    )
    held = parts.select(F.col("conv_id").alias("path"), "start", F.col("text").alias("data"))
    return search.trim_to_blob(hits, held, 23)


@query("""WITH b AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n, CASE WHEN role = 'user' THEN '<-' ELSE '->' END AS arrow
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, lag(arrow) OVER w AS pa, lead(arrow) OVER w AS na FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, unnest(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) AS k FROM a),
h AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  + 3 * (k - 2) AS INT) AS off FROM s QUALIFY k > 1)
SELECT conv_id, turn, off,
  CASE WHEN off < 50 AND p IS NOT NULL THEN pa || right(p, 50 - off) ELSE '' END || arrow || substring(text, greatest(off - 50, 0) + 1, least(off, 50)) AS before,
  substring(text, off + 4, 30) || CASE WHEN length(text) - off - 3 < 30 AND n IS NOT NULL
    THEN na || left(n, 30 - (length(text) - off - 3)) ELSE '' END AS after
FROM h""")
def hit_context(spark, sf):
    return search.hit_contexts(table(spark, sf, "conversations"), "the", "conv_id", "turn", "role", "text", client="user")


@query(f"WITH {HITS} SELECT path, count(*) AS hits, string_agg(off, ',' ORDER BY off) AS offsets FROM h GROUP BY path")
def results_by_file(spark, sf):
    return search.results_by_file(search.locate(streams(spark, sf), "the"))


@query("""WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations)
SELECT conv_id, off, turn, role FROM b JOIN conversations USING (conv_id, turn), (VALUES (100), (700), (5000)) r(off)
WHERE off >= start AND off < start + length(b.text)""")
def offset_to_stream(spark, sf):
    parts = blobs(spark, sf).withColumn("part", F.col("conv_id"))
    asked = parts.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, (100, 700, 5000)))).alias("off"))
    return search.offset_to_stream(asked, parts).select("conv_id", "off", "turn", "role")


@query("""WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
f AS (SELECT DISTINCT conv_id FROM b WHERE 300 >= start AND 300 < start + length(text))
SELECT conv_id, turn, md5(text) AS data_md5 FROM conversations JOIN f USING (conv_id)""")
def stream_of_offset(spark, sf):
    parts = blobs(spark, sf).withColumn("part", F.col("conv_id"))
    asked = parts.select("part").distinct().withColumn("off", F.lit(300))
    return search.stream_of_offset(asked, parts, "conv_id").select("conv_id", "turn", F.md5("text").alias("data_md5"))


@query("SELECT source AS service, count(*) AS files FROM documents GROUP BY source")
def service_list(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("service")).agg(F.count("*").alias("files"))


# ---------------------------------------------------------------- flows

SESSIONS = f"""{EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)"""


def user_sessions(spark, sf):
    return flows.sessions(events(spark, sf), ["user_id"], "at", ["at", "event_id"], 6 * 3600)


@query(f"""WITH {SESSIONS} SELECT user_id, session, count(*) AS packets, CAST(count(*) FILTER (dir = 'cs') AS BIGINT) AS client_packets,
  epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY user_id, session""")
def flow_sessions(spark, sf):
    return user_sessions(spark, sf).groupBy("user_id", "session").agg(
        F.count("*").alias("packets"), F.count_if(F.col("dir") == "cs").alias("client_packets"),
        F.unix_micros(F.min("at")).alias("start_us"), F.unix_micros(F.max("at")).alias("end_us"),
    )


@query(f"""WITH {SESSIONS} SELECT user_id, session, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS lasts_us
FROM s GROUP BY user_id, session HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 300000000""")
def long_flows(spark, sf):
    one = flows.flow_counters(user_sessions(spark, sf), ["user_id", "session"], "at", F.lit(1), F.col("dir") == "cs")
    lasts = F.unix_micros("end_time") - F.unix_micros("start_time")
    return flows.long_flows(one).select("user_id", "session", lasts.alias("lasts_us"))


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN dir = lag(dir) OVER w THEN 0 ELSE 1 END AS turn
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM g)
SELECT user_id, run, dir, count(*) AS segments, min(event_id) AS first_event FROM r GROUP BY user_id, run, dir""")
def direction_runs(spark, sf):
    runs = flows.direction_runs(events(spark, sf), ["user_id"], ["at", "event_id"], "dir")
    return runs.groupBy("user_id", "run", "dir").agg(F.count("*").alias("segments"), F.min("event_id").alias("first_event"))


@query("SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS stream FROM conversations GROUP BY conv_id, role")
def half_streams(spark, sf):
    return flows.half_streams(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT l_orderkey, CAST(sum(l_quantity) * 8192 AS BIGINT) AS total_bytes FROM lineitem
GROUP BY l_orderkey HAVING sum(l_quantity) * 8192 >= 1048576""")
def large_flows(spark, sf):
    lines = table(spark, sf, "lineitem")
    one = flows.flow_counters(lines, ["l_orderkey"], "l_shipdate", F.col("l_quantity") * 8192, F.col("l_returnflag") == "R")
    total = (F.col("client_bytes") + F.col("server_bytes")).cast("long")
    return flows.large_flows(one).select("l_orderkey", total.alias("total_bytes"))


@query(f"""WITH {EVENTS} SELECT user_id, count(*) FILTER (dir = 'cs') AS client_packets, count(*) FILTER (dir = 'sc') AS server_packets,
  round(coalesce(sum(value) FILTER (dir = 'cs'), 0), 2) AS client_bytes, round(coalesce(sum(value) FILTER (dir = 'sc'), 0), 2) AS server_bytes,
  epoch_us(min(ts)) AS start_us FROM e GROUP BY user_id""")
def flow_counters(spark, sf):
    one = flows.flow_counters(events(spark, sf), ["user_id"], "at", F.col("value"), F.col("dir") == "cs")
    return one.select(
        "user_id", "client_packets", "server_packets", F.round("client_bytes", 2).alias("client_bytes"),
        F.round("server_bytes", 2).alias("server_bytes"), F.unix_micros("start_time").alias("start_us"),
    )


@query(f"""WITH {SHIPMENTS} SELECT least(client, server) AS peer_lo, greatest(client, server) AS peer_hi, count(*) AS flows,
  CAST(sum(l_quantity) AS BIGINT) AS bytes FROM s GROUP BY 1, 2""")
def netflow_groups(spark, sf):
    return flows.netflow_groups(
        shipments(spark, sf), "client", "server", {"flows": F.count("*"), "bytes": F.sum("l_quantity").cast("long")}
    )


SEGMENTS = """n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, (n - n % 3 // 2 + n // 7) * 4 AS o, event_id, lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS data FROM n)"""


@query(f"""WITH {SEGMENTS}, one AS (SELECT user_id, o, arg_max(data, event_id) AS data FROM s GROUP BY user_id, o),
span AS (SELECT user_id, unnest(generate_series(min(o), max(o), 4)) AS o FROM one GROUP BY user_id)
SELECT user_id, string_agg(coalesce(data, '....'), '' ORDER BY o) AS data, bool_or(data IS NULL) AS has_gap
FROM span LEFT JOIN one USING (user_id, o) GROUP BY user_id""")
def reassemble_segments(spark, sf):
    """Every event is a segment; every third is sent again, and each seventh leaves a hole behind it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    place = (F.col("n") - F.floor(F.col("n") % 3 / 2) + F.floor(F.col("n") / 7)) * 4
    segments = table(spark, sf, "events").withColumn("n", n).select(
        "user_id", place.alias("o"), "event_id", F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0").alias("data")
    )
    return flows.reassemble(segments, ["user_id"], "o", "event_id", "data", gaps="pad", fill=".")


@query("""SELECT conv_id, turn, role, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hex_offset FROM conversations""")
def hex_offsets(spark, sf):
    return flows.hex_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "hex_offset")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 30 AS a, l_linenumber * 30 + CAST(l_quantity AS INT) AS b FROM lineitem),
m AS (SELECT *, coalesce(greatest(a - max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM r)
SELECT l_orderkey, min(a) AS first, max(b) AS last, CAST(sum(gap) AS BIGINT) AS gaps,
  CAST(max(b) - min(a) - sum(gap) AS BIGINT) AS covered FROM m GROUP BY l_orderkey""")
def range_coverage(spark, sf):
    a = F.col("l_linenumber") * 30
    ranges = table(spark, sf, "lineitem").select("l_orderkey", a.alias("a"), (a + F.col("l_quantity").cast("int")).alias("b"))
    return flows.range_coverage(ranges, ["l_orderkey"], "a", "b")


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS reads, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS writes,
  CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'B' WHEN bool_or(l_returnflag = 'R') THEN 'R'
    WHEN bool_or(l_returnflag = 'A') THEN 'W' ELSE '-' END AS mode FROM lineitem GROUP BY l_orderkey""")
def smb_file_modes(spark, sf):
    reads, writes = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") == "A")
    one = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(reads.alias("reads"), writes.alias("writes"))
    return one.withColumn("mode", txt.access_mode(F.col("reads"), F.col("writes")))


# ---------------------------------------------------------------- correlation


@query("""WITH q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id, n, q.event_id AS q_event_id, r.event_id AS r_event_id FROM q FULL JOIN r USING (user_id, n)""")
def dns_pairing(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    q, r = (e.filter(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    return correlate.pair_by_key(q, r, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("n").cast("long").alias("n"), "q_event_id", "r_event_id")


@query("""WITH n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(text) AS request, CASE WHEN r <> 'user' THEN md5(t) END AS response FROM n WHERE role = 'user'""")
def http_pairing(spark, sf):
    paired = correlate.pair_next(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user", ["text"])
    return paired.select("conv_id", "turn", F.md5("text").alias("request"), F.md5("next_text").alias("response"))


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type FROM events),
m AS (SELECT s.user_id, s.ts AS a, r.ts AS b, row_number() OVER (PARTITION BY s.user_id ORDER BY s.ts, r.ts) AS n FROM x s JOIN x r
  ON s.user_id = r.user_id AND s.event_type = 'signup' AND r.event_type = 'error' AND r.ts >= s.ts)
SELECT user_id AS src, epoch_us(a) AS syn_us, epoch_us(b) AS reset_us FROM m WHERE n = 1""")
def failed_connects(spark, sf):
    e = events(spark, sf).withColumn("seq", F.col("user_id") % 50)
    syns = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("src"), F.lit(1024).alias("sport"), F.lit(-1).cast("long").alias("dst"), F.lit(80).alias("dport"), "seq", F.col("at").alias("ts")
    )
    resets = e.filter("event_type = 'error'").select(
        F.lit(-1).cast("long").alias("src"), F.lit(80).alias("sport"), F.col("user_id").alias("dst"), F.lit(1024).alias("dport"), (F.col("seq") + 1).alias("ack"), F.col("at").alias("ts")
    )
    return correlate.failed_connects(syns, resets).select("src", F.unix_micros("ts").alias("syn_us"), F.unix_micros("reset_ts").alias("reset_us"))


@query("""SELECT user_id, count(*) AS packets, round(sum(value), 2) AS bytes FROM events p WHERE EXISTS (SELECT 1 FROM events s
  WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR) GROUP BY user_id""")
def track_sessions(spark, sf):
    e = events(spark, sf)
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("span_start"), F.expr("at + INTERVAL 1 HOUR").alias("span_end"))
    seen = correlate.tracked(e, spans, ["user_id"], "at")
    return seen.groupBy("user_id").agg(F.count("*").alias("packets"), F.round(F.sum("value"), 2).alias("bytes"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def asof_state(spark, sf):
    state = F.when(F.col("event_type") == "purchase", F.col("value"))
    return correlate.as_of(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], state, "last_purchase").select("event_id", "user_id", "last_purchase")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_files_only(spark, sf):
    return correlate.new_only(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


IP_SQL = "CAST((CAST(l_orderkey AS HUGEINT) * 2654435761 + l_linenumber * 40503) % 4294967296 AS BIGINT)"
RESERVED_SQL = """ip < 16777216 OR ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 1681915904 AND 1686110207 OR ip BETWEEN 2130706432 AND 2147483647
  OR ip BETWEEN 2851995648 AND 2852061183 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3221225472 AND 3221225479 OR ip BETWEEN 3221225984 AND 3221226239
  OR ip BETWEEN 3227017984 AND 3227018239 OR ip BETWEEN 3232235520 AND 3232301055 OR ip BETWEEN 3323068416 AND 3323199487 OR ip BETWEEN 3325256704 AND 3325256959
  OR ip BETWEEN 3405803776 AND 3405804031 OR ip >= 3758096384"""


def addresses(spark, sf):
    ip = F.pmod(F.col("l_orderkey") * F.lit(2654435761) + F.col("l_linenumber") * 40503, F.lit(1 << 32)).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ip.alias("ip"))


@query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {IP_SQL} AS ip FROM lineitem) WHERE {RESERVED_SQL}")
def cidr_reserved(spark, sf):
    return addresses(spark, sf).filter(filters.in_reserved(F.col("ip")))


@query(f"""WITH a AS (SELECT l_orderkey, {IP_SQL} AS ip FROM lineitem),
g AS (SELECT CAST(n_nationkey AS BIGINT) * 150000000 AS lo, CAST(n_nationkey AS BIGINT) * 150000000 + 99999999 AS hi, n_name AS cc FROM nation)
SELECT coalesce(cc, '--') AS cc, count(*) AS packets FROM a LEFT JOIN g ON ip BETWEEN lo AND hi GROUP BY 1""")
def geo_enrichment(spark, sf):
    lo = F.col("n_nationkey").cast("long") * 150000000
    geo = table(spark, sf, "nation").select(lo.alias("lo"), (lo + 99999999).alias("hi"), F.col("n_name").alias("cc"))
    found = correlate.ranges_lookup(addresses(spark, sf), geo, "ip")
    return found.groupBy(F.coalesce("cc", F.lit("--")).alias("cc")).agg(F.count("*").alias("packets"))


# ---------------------------------------------------------------- filters and patterns


@query(f"""WITH {SHIPMENTS}, m AS (
  SELECT 'first' AS mode, CASE WHEN client = 'NATION_7' THEN 'client' WHEN server = 'NATION_7' THEN 'server' END AS label FROM s
  UNION ALL SELECT 'neither', CASE WHEN client <> 'NATION_7' AND server <> 'NATION_7' THEN 'neither' END FROM s
  UNION ALL SELECT 'both', CASE WHEN client = 'NATION_7' AND server = 'NATION_7' THEN 'both' END FROM s
  UNION ALL SELECT 'notboth', CASE WHEN (client = 'NATION_7') <> (server = 'NATION_7') THEN 'notboth' END FROM s)
SELECT mode, label, count(*) AS flows FROM m WHERE label IS NOT NULL GROUP BY mode, label""")
def country_filter(spark, sf):
    s = shipments(spark, sf)
    modes = {"first": {}, "neither": {"neither": True}, "both": {"both": True}, "notboth": {"not_both": True}}
    label = lambda o: filters.country_label(F.col("client"), F.col("server"), "NATION_7", **o)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), label(o).alias("label")) for m, o in modes.items())))
    return s.select(each.alias("m")).select("m.*").filter("label is not null").groupBy("mode", "label").agg(F.count("*").alias("flows"))


@query(f"""WITH {SHIPMENTS}, m AS (SELECT CASE WHEN contains(lower(client), 'nation_1') THEN 'client' WHEN contains(lower(server), 'nation_1') THEN 'server' END AS label FROM s)
SELECT label, count(*) AS flows FROM m WHERE label IS NOT NULL GROUP BY label""")
def asn_filter(spark, sf):
    label = filters.asn_match(F.col("client"), F.col("server"), "Nation_1")
    return shipments(spark, sf).withColumn("label", label).filter("label is not null").groupBy("label").agg(F.count("*").alias("flows"))


RULES = filters.parse_rules('''
# content rules of the sample queries
alert tcp any any -> any any (msg:"early"; content:"THE"; nocase; offset:2; depth:60;)
alert tcp any any -> any any (msg:"near"; content:"the"; content:"and"; distance:0; within:60;)
alert tcp any any -> any any (msg:"hex"; content:"|0a|The";)
''')
EVERY_SQL = [
    "(strpos(substring(lower(text), 3), 'the') > 0 AND strpos(substring(lower(text), 3), 'the') + 2 <= 60)",
    "regexp_matches(text, '(?s)the.{0,57}and')",
    "(strpos(text, chr(10) || 'The') > 0)",
]


def rule_columns():
    return [filters.rule_predicate(r, data="text", proto="proto") for r in RULES]


def with_rules(spark, sf, mode):
    docs = table(spark, sf, "documents").withColumn("proto", F.lit("tcp"))
    return filters.apply_rules(docs, rule_columns(), mode).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {' OR '.join(EVERY_SQL)}")
def rule_any(spark, sf):
    return with_rules(spark, sf, "any")


@query(f"SELECT doc_id FROM documents WHERE {' AND '.join(EVERY_SQL)}")
def rule_all(spark, sf):
    return with_rules(spark, sf, "all")


@query(f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(EVERY_SQL)})")
def rule_none(spark, sf):
    return with_rules(spark, sf, "none")


@query(f"""SELECT doc_id, CASE WHEN {EVERY_SQL[0]} THEN 'early' WHEN {EVERY_SQL[1]} THEN 'near' ELSE 'hex' END AS rule
FROM documents WHERE {' OR '.join(EVERY_SQL)}""")
def rule_first(spark, sf):
    docs = table(spark, sf, "documents").withColumn("proto", F.lit("tcp"))
    return filters.first_rule(docs, rule_columns(), [r.message for r in RULES]).select("doc_id", "rule")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, rtrim(x) AS line, regexp_extract(rtrim(x), '(?i)(licen[cs]e[a-z]*)', 1) AS m1
FROM l WHERE regexp_matches(rtrim(x), '(?i)(licen[cs]e[a-z]*)')""")
def grep_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return filters.grep_lines(docs, "text", "(licen[cs]e[a-z]*)", ignore_case=True, groups=1)


LINK = 'href="([^"]*)"'


@query(f"""SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS m1,
  CAST(generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) - 1 AS INT) AS match_no FROM pages""")
def grep_iterate(spark, sf):
    return filters.grep_iterate(table(spark, sf, "pages").select("page_id", "html"), "html", LINK)


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND regexp_matches(x.text, 'tion[.,]'))")
def grep_invert(spark, sf):
    rows = table(spark, sf, "conversations")
    hit = rows.filter(F.col("text").rlike("tion[.,]")).select("conv_id").distinct()
    return filters.grep_chain(rows, hit, ["conv_id"], invert=True).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND regexp_matches(x.text, 'tion[.,]'))")
def grep_subset(spark, sf):
    rows = table(spark, sf, "conversations")
    hit = rows.filter(F.col("text").rlike("tion[.,]")).select("conv_id").distinct()
    return filters.grep_chain(rows, hit, ["conv_id"]).select("conv_id", "turn")


@query(f"""SELECT m1 AS link, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS m1 FROM pages) GROUP BY m1""")
def html_links(spark, sf):
    found = filters.grep_iterate(table(spark, sf, "pages").select("page_id", "html"), "html", LINK)
    return found.select("page_id", "m1").distinct().groupBy(F.col("m1").alias("link")).agg(F.count("*").alias("pages"))


@query("""SELECT page_id, length(html) AS size FROM pages WHERE starts_with(html, '<!DOCTYPE html><html lang="en"')""")
def flash_like_magic(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.filter(txt.has_magic(F.col("html"), '<!DOCTYPE html><html lang="en"')).select("page_id", F.length("html").cast("long").alias("size"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?]+([^?]*)', 1) AS path, "
       "CASE WHEN contains(url, '?') THEN regexp_extract(url, '[?&][^=&]*=([^&]*)', 1) END AS first_value FROM pages")
def url_params(spark, sf):
    first = F.element_at(F.map_values(txt.url_parameters(F.nullif(F.substring_index("url", "?", -1), F.col("url")))), 1)
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/?]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/?]+([^?]*)", 1).alias("path"), first.alias("first_value"),
    )


@query("SELECT page_id, CASE WHEN length(url) > 30 THEN substring(url, 1, 30) || '[truncated]' ELSE url END AS uri FROM pages")
def uri_truncation(spark, sf):
    return table(spark, sf, "pages").select("page_id", txt.truncated(F.col("url"), 30).alias("uri"))


# ---------------------------------------------------------------- scalar functions, sets, sinks


@query("SELECT o_orderkey, CAST(xor(o_orderkey, 90) AS BIGINT) AS masked, CAST(xor(xor(o_orderkey, 90), 90) AS BIGINT) AS back FROM orders")
def xor_transform(spark, sf):
    masked = F.col("o_orderkey").bitwiseXOR(F.lit(90))
    return table(spark, sf, "orders").select("o_orderkey", masked.alias("masked"), masked.bitwiseXOR(F.lit(90)).alias("back"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '^[ -~]$') THEN c
  ELSE regexp_replace(lower(hex(encode(c))), '(..)', '\\\\x\\1', 'g') END), '') AS escaped FROM conversations""")
def escape_text(spark, sf):
    latin = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "conversations").select("conv_id", "turn", escape_column(latin).alias("escaped"))


@query("SELECT doc_id, md5(rtrim(text, chr(0))) AS payload_md5 FROM documents")
def payload_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", txt.payload_md5(F.col("text")).alias("payload_md5"))


@query("""WITH m AS (SELECT DISTINCT c_name, substring(sha1('secret' || c_name), 1, 12) AS alias FROM customer)
SELECT alias, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN m USING (c_name) GROUP BY alias""")
def anonymise(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_name")
    alias = net.anonymous_names(people.select("c_name"), "c_name", "secret")
    named = table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(alias, "c_name")
    return named.groupBy("alias").agg(F.count("*").alias("orders"))


@query(f"WITH a AS (SELECT DISTINCT {IP_SQL} AS ip FROM lineitem) SELECT ip, concat_ws('.', ip // 16777216, ip // 65536 % 256, ip // 256 % 256, ip % 256) AS address FROM a")
def ip_text(spark, sf):
    ips = addresses(spark, sf).select("ip").distinct()
    shown = ips.withColumn("address", net.int_to_ip(F.col("ip")))
    return shown.filter(net.ip_to_int(F.col("address")) == F.col("ip"))


@query("SELECT r_name AS name, 'region' AS origin FROM region UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT n_name, 'nation' FROM nation")
def union_merge(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("origin"))
    region = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("origin"))
    return region.unionByName(nation).unionByName(nation)


@query("SELECT event_id, CAST(to_json({'decoder': 'events', 'user_id': user_id, 'kind': event_type}) AS VARCHAR) AS line FROM events")
def alerts_json(spark, sf):
    from rillspan.sources.sinks import json_lines

    rows = table(spark, sf, "events").select("event_id", F.lit("events").alias("decoder"), "user_id", F.col("event_type").alias("kind"))
    return json_lines(rows, ["decoder", "user_id", "kind"], keep=["event_id"])


@query("SELECT event_id, printf('%-10s %5d', event_type, user_id) AS line FROM events")
def alerts_text(spark, sf):
    from rillspan.sources.sinks import text_lines

    return text_lines(table(spark, sf, "events"), "%(event_type)-10s %(user_id)5d", keep=["event_id"])


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS symbol FROM conversations), n AS (SELECT symbol, count(*) AS n FROM c GROUP BY symbol)
SELECT symbol, n, CAST(coalesce(sum(n) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM n""")
def symbol_cumulative(spark, sf):
    return txt.symbol_table(table(spark, sf, "conversations"), "text")


@query("""WITH t AS (SELECT conv_id, sha1(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id)
SELECT sha, min(conv_id) AS conv_id, count(*) AS copies FROM t GROUP BY sha""")
def transcript_dedupe(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("said"))))
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sha1(F.array_join(F.transform(turns, lambda x: x["said"]), "\n")).alias("sha"))
    return each.groupBy("sha").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))


@query(f"""SELECT CASE l_linenumber WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 4 THEN 'IP' ELSE CAST(l_linenumber AS VARCHAR) END AS proto, count(*) AS packets
FROM lineitem GROUP BY 1""")
def protocol_names(spark, sf):
    return table(spark, sf, "lineitem").groupBy(net.protocol_name(F.col("l_linenumber")).alias("proto")).agg(F.count("*").alias("packets"))


@query("""WITH f AS (SELECT l_partkey, l_linenumber, l_orderkey, chr(CAST(65 + l_orderkey % 26 AS INT)) AS c FROM lineitem),
o AS (SELECT l_partkey, l_linenumber, arg_max(c, l_orderkey) AS c FROM (SELECT l_partkey, l_linenumber, l_orderkey, max(c) AS c FROM f GROUP BY ALL) GROUP BY 1, 2)
SELECT l_partkey, count(*) AS n_blocks, string_agg(c, '' ORDER BY l_linenumber) AS data FROM o GROUP BY l_partkey""")
def tftp_rebuild(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("c", F.chr((F.col("l_orderkey") % 26 + 65).cast("long")))
    return correlate.rebuild_blocks(rows, ["l_partkey"], "l_linenumber", "l_orderkey", "c")
