"""Decoders over packets: from frames to the records that each protocol reports.

Every function takes a table of packets (``sources.capture.packets``), follows
connections where the protocol has them, parses payloads in Arrow batches and
pairs what belongs together with joins and windows.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspan.functions import net, protocols, text
from rillspan.operators import correlate, enrich, filters, tcp

DNS_PORTS, HTTP_PORTS, FTP_PORTS, SMB_PORTS, DHCP_PORTS, TFTP_PORTS = (53,), (80, 8080, 8000), (21,), (445, 139), (67, 68), (69,)


def on_ports(packets: DataFrame, proto: int, *ports: int) -> DataFrame:
    return packets.filter((F.col("proto") == proto) & filters.either_port(F.col("sport"), F.col("dport"), *ports))


def with_connection(blobs: DataFrame) -> DataFrame:
    """Blobs with ``conn``, one text for each connection."""
    return blobs.withColumn("conn", F.concat_ws("#", "conn_key", "conn_no"))


# ---------------------------------------------------------------- DNS


def dns_messages(packets: DataFrame) -> DataFrame:
    """``client, client_port, server, id, m, ts_us`` of every DNS message; the server is the side of port 53."""
    message = protocols.parsed(protocols.dns, protocols.DNS)(F.col("payload"))
    found = tcp.whole(on_ports(packets, 17, *DNS_PORTS)).withColumn("m", message).filter("m.qname is not null or m.id is not null")
    answer = F.col("m.is_response")
    side = lambda a, b: F.when(answer, F.col(a)).otherwise(F.col(b))
    return found.select(
        side("dip", "sip").alias("client"), side("dport", "sport").alias("client_port"), side("sip", "dip").alias("server"),
        F.col("m.id").alias("id"), "m", "ts_us", "frame_no",
    )


def dns_pairs(packets: DataFrame, responses: int | None = 1) -> DataFrame:
    """Requests with up to ``responses`` answers each (all with None), unanswered requests and unsolicited answers."""
    m = dns_messages(packets)
    key = ["client", "client_port", "server", "id"]
    return correlate.pair_following(m.filter("not m.is_response"), m.filter("m.is_response"), key, ["ts_us", "frame_no"], responses)


def dns_alerts(packets: DataFrame, showall: bool = False, responses: int | None = 1, **kept: bool) -> DataFrame:
    """One line for each pair worth a report; only address and name questions unless ``showall``."""
    pairs = dns_pairs(packets, responses)
    asked = F.coalesce(F.col("q_m"), F.col("r_m"))
    n = F.coalesce(F.size("r_m.answers"), F.lit(0))
    keep = enrich.dns_kept(F.col("r_m.rcode"), n, F.col("q_m").isNotNull(), F.col("r_m").isNotNull(), **kept)
    usual = asked["qtype"].isin("A", "AAAA", "CNAME", "PTR")
    line = protocols.dns_line(asked, F.col("r_m.answers"), F.col("r_m.rcode"))
    return pairs.filter(keep if showall else keep & usual).select(
        "client", "server", "id", "response_no", F.coalesce("q_ts_us", "r_ts_us").alias("ts_us"), line.alias("data")
    )


def dns_answers(packets: DataFrame) -> DataFrame:
    """One row for each answer that holds an address."""
    pairs = dns_pairs(packets, None).filter("r_m is not null")
    return pairs.select("client", "id", F.col("r_m.qname").alias("qname"), "response_no", F.posexplode("r_m.answers").alias("answer_no", "a")).filter(
        F.col("a.type").isin("A", "AAAA")
    ).select("client", "id", "qname", "response_no", "answer_no", F.col("a.value").alias("address"), F.col("a.ttl").alias("ttl"))


def reserved_answers(packets: DataFrame) -> DataFrame:
    """Answers inside reserved address blocks."""
    return dns_answers(packets).filter(filters.is_reserved(F.col("address")))


def answers_by_country(packets: DataFrame, ranges: DataFrame, home: str = "US", code: str = "", tag: str = "cc") -> DataFrame:
    """Answers from abroad, or from one country or network, with a line each."""
    found = net.located(dns_answers(packets), ranges, "address")
    name = F.coalesce(tag, F.lit(enrich.UNKNOWN))
    keep = name == code if code else ~name.isin(home, enrich.UNKNOWN)
    line = F.format_string("A: %s (%s) (ttl %ds)", "address", name, "ttl")
    return found.filter(keep).select("client", "id", "response_no", "answer_no", line.alias("data"))


def tunnelled(packets: DataFrame) -> DataFrame:
    """TXT questions in capitals whose answer decodes as base64."""
    pairs = dns_pairs(packets).filter("q_m is not null and r_m is not null")
    first = F.col("r_m.answers")[0]["value"]
    return pairs.filter(protocols.looks_tunnelled(F.col("q_m.qtype"), F.col("q_m.qname"), first)).select(
        "client", "id", F.split_part("q_m.qname", F.lit("."), F.lit(1)).alias("command"), first.alias("answer")
    )


# ---------------------------------------------------------------- HTTP


def http_pairs(packets: DataFrame, ports: tuple[int, ...] = HTTP_PORTS, **options) -> DataFrame:
    """Requests ``m`` with the response ``next_m`` that follows on their connection, if any."""
    message = protocols.parsed(protocols.http, protocols.HTTP)(F.col("data"))
    blobs = with_connection(tcp.connections(on_ports(packets, 6, *ports), **options)).filter("data is not null").withColumn("m", message)
    ends = ["client_ip", "client_port", "server_ip", "server_port"]
    asked = (F.col("direction") == "cs") & (F.col("m.kind") == "request")
    paired = correlate.pair_next(blobs, "conn", "blob_no", F.coalesce(asked, F.lit(False)), ["m", "blob_start_us", *ends])
    return paired.drop(*(f"next_{c}" for c in ends))


def header(message: str, name: str) -> Column:
    return text.header(F.coalesce(F.col(f"{message}.headers"), F.expr("cast(array() as array<struct<name:string,value:string>>)")), name)


def web(packets: DataFrame, max_uri: int = 30, **options) -> DataFrame:
    """One alert for each request with what came back."""
    body = F.decode("next_m.body", "ISO-8859-1")
    return http_pairs(packets, **options).select(
        "client_ip", "client_port", "server_ip", "server_port", F.col("m.method").alias("method"), header("m", "host").alias("host"),
        text.truncated(F.col("m.uri"), max_uri).alias("uri"), header("m", "user-agent").alias("user_agent"), header("m", "referer").alias("referer"),
        text.cookies(header("m", "cookie")).alias("cookies"), F.col("next_m.status").alias("status"), F.col("next_m.reason").alias("reason"),
        F.length("next_m.body").cast("long").alias("size"), text.payload_md5(body).alias("body_md5"), header("next_m", "content-type").alias("mime"),
        text.last_modified(F.coalesce("next_m.headers", F.expr("cast(array() as array<struct<name:string,value:string>>)"))).alias("modified"),
        F.col("m.uri").alias("whole_uri"), F.col("m.body").alias("sent"), F.col("next_m.body").alias("body"), header("m", "range").alias("range"),
    )


def httpdump(packets: DataFrame, url: str = "", **options) -> DataFrame:
    """Requests whose host and path match a regular expression, parameters decoded."""
    found = web(packets, **options)
    params = text.url_parameters(F.nullif(F.substring_index("whole_uri", "?", -1), F.col("whole_uri")))
    return found.filter(F.concat("host", "whole_uri").rlike(url)).withColumn("parameters", params)


def uploads(packets: DataFrame, **options) -> DataFrame:
    """Files of multipart requests."""
    sent = F.decode("sent", "ISO-8859-1")
    posted = web(packets, **options).filter("method = 'POST' and length(sent) > 0")
    return posted.select("client_ip", "client_port", F.posexplode(text.multipart_files(sent)).alias("file_no", "f")).select("client_ip", "client_port", "file_no", "f.*")


def rip_http(packets: DataFrame, mime: str = "", name: str = "", **options) -> DataFrame:
    """Bodies whose content type and file name match, each with its digest."""
    file = F.substring_index(F.split_part("whole_uri", F.lit("?"), F.lit(1)), "/", -1)
    found = web(packets, **options).filter("length(body) > 0").withColumn("name", text.local_filename(file))
    return found.filter(F.col("mime").rlike(mime) & F.col("name").rlike(name)).select("client_ip", "client_port", "name", "mime", "body", F.md5("body").alias("md5"))


def flash(packets: DataFrame, **options) -> DataFrame:
    """Successful downloads of flash files."""
    hit = protocols.is_flash(F.col("status"), F.col("mime"), F.decode("body", "ISO-8859-1"))
    return web(packets, **options).filter(hit)


def range_probes(packets: DataFrame, **options) -> DataFrame:
    """Requests for the last possible byte and what they did."""
    return web(packets, **options).withColumn("verdict", protocols.range_probe(F.col("range"), F.col("status"))).filter("verdict is not null")


def partial_bodies(parts: DataFrame, key: list[str], start: str = "first", data: str = "body") -> DataFrame:
    """Bodies joined from partial ones by their place: of parts at one place the longest; ``whole`` tells whether nothing is missing."""
    one = parts.groupBy(*key, start).agg(F.max_by(data, F.length(data)).alias("_d"))
    laid = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("long").alias("o"), F.col("_d").alias("d")))).alias("s"))
    begin = F.struct(F.col("s")[0]["o"].alias("at"), F.lit(b"").alias("out"), (F.col("s")[0]["o"] == 0).alias("whole"))

    def step(acc: Column, x: Column) -> Column:
        skip = F.greatest(acc["at"] - x["o"], F.lit(0))
        tail = F.substring(x["d"], (skip + 1).cast("int"), F.length(x["d"]))
        return F.struct(
            F.greatest(acc["at"], x["o"] + F.length(x["d"])).alias("at"), F.concat(acc["out"], tail).alias("out"), (acc["whole"] & (x["o"] <= acc["at"])).alias("whole")
        )

    return laid.withColumn("_r", F.aggregate("s", begin, step)).select(*key, F.col("_r.out").alias("body"), F.col("_r.whole").alias("whole"))


# ---------------------------------------------------------------- flows and streams


def netflow(packets: DataFrame, **options) -> DataFrame:
    """One record for each connection with its counters."""
    return tcp.connection_records(tcp.connections(packets, **options))


def synrst(packets: DataFrame) -> DataFrame:
    """Connection attempts that were refused."""
    p = packets.filter("proto = 6").select(
        F.col("sip").alias("src"), "sport", F.col("dip").alias("dst"), "dport", "seq", "ack", F.col("ts_us").alias("ts"), F.col("flags").bitwiseAND(F.lit(23)).alias("kind")
    )
    return correlate.failed_connects(p.filter(F.col("kind") == tcp.SYN), p.filter(F.col("kind") == tcp.RST | tcp.ACK))


def followstream(packets: DataFrame, encoding: str = "ISO-8859-1", **options) -> DataFrame:
    """Blobs in order with an arrow, and whether something is missing in them."""
    blobs = with_connection(tcp.connections(packets, **options)).filter("data is not null")
    arrow = F.when(F.col("direction") == "cs", "->").otherwise("<-")
    return blobs.select("conn", "client_ip", "client_port", "server_ip", "server_port", "blob_no", arrow.alias("arrow"), F.decode("data", encoding).alias("said"), "has_gap")


def tracked_packets(packets: DataFrame, targets: list[str], sources: list[str] | None = None, **options) -> DataFrame:
    """Packets to or from a source while it has a connection to a target open."""
    c = netflow(packets, **options).filter(F.col("server_ip").isin(*targets))
    if sources:
        c = c.filter(F.col("client_ip").isin(*sources))
    spans = c.select(F.col("client_ip").alias("host"), F.col("start_us").alias("span_start"), F.col("end_us").alias("span_end"))
    each = packets.withColumn("host", F.explode(F.array_distinct(F.array("sip", "dip"))))
    return correlate.tracked(each, spans, ["host"], "ts_us")


def xored(blobs: DataFrame, keys: dict[str, bytes], resync: bool = False) -> DataFrame:
    """Blobs with ``plain``: data combined with the key of its direction.

    Each direction's key runs on from blob to blob; with ``resync`` it starts
    again in every blob, right after the key's own text where that is sent.
    """
    before = Window.partitionBy("conn", "direction").orderBy("blob_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = blobs.withColumn("_at", F.coalesce(F.sum(F.length("data")).over(before), F.lit(0)).cast("long"))

    @F.pandas_udf("binary")
    def plain(data: pd.Series, side: pd.Series, at: pd.Series) -> pd.Series:
        def one(x, d, a):
            key = keys.get(d, b"")
            if x is None or not key:
                return x
            if not resync:
                turn = int(a) % len(key)
                return text.xor_bytes(bytes(x), key[turn:] + key[:turn])
            head, found, rest = bytes(x).partition(key)
            return text.xor_bytes(head, key) + found + text.xor_bytes(rest, key)

        return pd.Series([one(*row) for row in zip(data, side, at, strict=True)])

    return placed.withColumn("plain", plain("data", "direction", "_at")).drop("_at")


# ---------------------------------------------------------------- FTP, TFTP, DHCP


def ftp_transfers(packets: DataFrame, **options) -> DataFrame:
    """Transfers of control connections with the data connection that carried each."""
    control = with_connection(tcp.connections(on_ports(packets, 6, *FTP_PORTS), **options)).filter("data is not null")

    names = ["conn", "transfer_no", "command", "file", "path", "user", "password", "ip", "port", "at"]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 6, pa.int32(), pa.int64()]

    def fold(batches):
        """Blobs come connection by connection, in order."""
        now, lines = None, []

        def told() -> list[tuple]:
            return [(now, n, *(t[k] for k in names[2:])) for n, t in enumerate(protocols.ftp_fold(lines))]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for conn, side, data, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conn != now:
                    rows += told()
                    now, lines = conn, []
                lines += [(side, x, at) for x in data.decode("latin-1").splitlines()]
            if rows:
                yield batch_of(rows)
        if rows := told():
            yield batch_of(rows)

    schema = "conn string, transfer_no int, command string, file string, path string, user string, password string, ip string, port int, at long"
    said = control.select("conn", "direction", "data", "blob_start_us", "blob_no").repartition("conn").sortWithinPartitions("conn", "blob_no")
    done = said.select("conn", "direction", "data", "blob_start_us").mapInArrow(fold, schema)
    data = with_connection(tcp.connections(packets.filter(~filters.either_port(F.col("sport"), F.col("dport"), *FTP_PORTS)), **options))
    whole = data.filter("data is not null").groupBy(F.col("conn").alias("data_conn"), F.col("server_ip").alias("ip"), F.col("server_port").alias("port"), F.col("start_us").alias("ts")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blob_no", F.decode("data", "ISO-8859-1").alias("d")))), lambda x: x["d"]), "").alias("body")
    )
    announced = done.select(F.struct("conn", "transfer_no").alias("conn"), "ip", "port", F.col("at").alias("ts"), F.struct(*done.columns).alias("_t"))
    met = correlate.with_announcements(announced, whole).filter("control_conn is not null").groupBy("control_conn").agg(
        F.max("_t").alias("_t"), F.collect_list(F.when(F.col("_is_data") == 1, F.col("body"))).alias("_bodies")
    )
    return met.select("_t.*", F.explode_outer("_bodies").alias("body"))


def tftp_files(packets: DataFrame) -> DataFrame:
    """Files from their blocks; the server answers from a port of its own choice."""
    m = protocols.parsed(protocols.tftp, protocols.TFTP)(F.col("payload"))
    udp = packets.filter("proto = 17")
    asked = udp.filter((F.col("dport") == TFTP_PORTS[0])).withColumn("m", m).filter("m.op in ('read', 'write')").select(
        F.col("sip").alias("client_ip"), F.col("sport").alias("client_port"), F.col("dip").alias("server_ip"), F.col("m.op").alias("op"), F.col("m.file").alias("file")
    )
    talk = udp.filter(~filters.either_port(F.col("sport"), F.col("dport"), *TFTP_PORTS)).withColumn("m", m).filter("m.op = 'data'")
    # either side may send the blocks
    side = lambda a, b, down: talk.select(
        F.col(a[0]).alias("client_ip"), F.col(a[1]).alias("client_port"), F.col(b[0]).alias("server_ip"), "m.block", F.decode("m.data", "ISO-8859-1").alias("data"),
        F.struct("ts_us", "frame_no").alias("arrival"), F.lit(down).alias("down"),
    )
    both = side(("dip", "dport"), ("sip",), True).unionByName(side(("sip", "sport"), ("dip",), False))
    joined = correlate.server_port_streams(asked, both).filter((F.col("op") == "read") == F.col("down"))
    return correlate.rebuild_blocks(joined, ["client_ip", "client_port", "server_ip", "op", "file"], "block", "arrival", "data")


def dhcp_leases(packets: DataFrame) -> DataFrame:
    """One row for each message; nothing is carried from one to the next."""
    m = protocols.parsed(protocols.dhcp, protocols.DHCP)(F.col("payload"))
    return on_ports(packets, 17, *DHCP_PORTS).withColumn("m", m).filter("m.xid is not null").select("ts_us", "m.*")


# ---------------------------------------------------------------- SMB


def smb_messages(packets: DataFrame, **options) -> DataFrame:
    """Messages of SMB connections: header, file name and number, data written."""
    blobs = with_connection(tcp.connections(on_ports(packets, 6, *SMB_PORTS), **options)).filter("data is not null")
    kinds = "conn string, client_ip string, server_ip string, blob_no int, message_no int, command int, status long, is_response boolean, tid int, uid int, mid int, file string, fid int, write_at long, written binary"
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, types[kind]) for n, kind in (x.split() for x in kinds.split(", "))])

    def run(batches):
        for batch in batches:
            rows = []
            for *head, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, raw in enumerate(protocols.smb_messages(data)):
                    try:
                        m = protocols.smb(raw)
                        wrote = protocols.smb_write(m)
                        rows.append((*head, n, m["command"], m["status"], m["is_response"], m["tid"], m["uid"], m["mid"], protocols.smb_filename(m), protocols.smb_fid(m), *(wrote or (None, None))))
                    except (ValueError, IndexError, protocols.struct.error):
                        continue
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

    return blobs.select("conn", "client_ip", "server_ip", "blob_no", "data").mapInArrow(run, kinds)


def smb_pairs(messages: DataFrame) -> DataFrame:
    """Requests with their response by connection and message number; without one the status is -1.

    A request meets every response of its number, by a window: messages are read once.
    """
    answers = F.collect_list(F.when(F.col("is_response"), F.struct("status", F.col("fid").alias("got_fid")))).over(Window.partitionBy("conn", "mid"))
    asked = messages.withColumn("_r", answers).filter("not is_response")
    each = asked.select(*(c for c in messages.columns if c not in ("is_response", "status")), F.explode_outer("_r").alias("_r"))
    return each.select(*each.drop("_r").columns, F.coalesce("_r.status", F.lit(-1)).alias("status"), F.col("_r.got_fid").alias("got_fid"))


def smb_named(packets: DataFrame, **options) -> DataFrame:
    """Requests on files with ``file_now``: a file number means the last file that was opened under it."""
    opens = F.col("file").isNotNull()
    pairs = smb_pairs(smb_messages(packets, **options)).filter(~opens | (F.col("status") == 0))
    numbered = pairs.withColumn("fid", F.when(opens, F.col("got_fid")).otherwise(F.col("fid")))
    return enrich.latest_names(numbered, ["conn"], ["blob_no", "message_no"], "fid", "file").filter("file_now is not null")


def smb_files(packets: DataFrame, **options) -> DataFrame:
    """Reads, writes and bytes of every file that was opened, with its access mode."""
    return enrich.file_activity(
        smb_named(packets, **options), ["conn", "client_ip", "server_ip", "file_now"], F.col("command") == 0x2E, F.col("command") == 0x2F, F.coalesce(F.length("written"), F.lit(0))
    ).withColumnRenamed("file_now", "file")


def smb_uploads(packets: DataFrame, **options) -> DataFrame:
    """Files as they were written, by offset."""
    parts = smb_named(packets, **options).filter("written is not null").select("conn", F.col("file_now").alias("file"), F.col("write_at").alias("first"), F.col("written").alias("body"))
    return partial_bodies(parts, ["conn", "file"]).withColumn("md5", F.md5("body"))


def psexec_sessions(packets: DataFrame, pipe: str = "(?i)psexec", **options) -> DataFrame:
    """Sessions that open a service's pipe: messages and bytes written through it per direction."""
    m = smb_messages(packets, **options)
    opened = F.max(F.coalesce(F.col("file").rlike(pipe), F.lit(False))).over(Window.partitionBy("conn"))
    return m.withColumn("_opened", opened).filter("_opened").groupBy("conn", "client_ip", "server_ip", "uid").agg(
        F.count_if(~F.col("is_response")).alias("requests"), F.count_if("is_response").alias("responses"),
        F.sum(F.coalesce(F.length("written"), F.lit(0))).alias("bytes_written"),
    )
