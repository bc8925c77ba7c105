"""Named transforms that chain, with options, and named sinks.

``a+b`` runs b on what a leaves; ``name:alias`` names the step's alerts.  All
but the last step of a chain must keep the rows' shape (``chainable``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.functions import bpf
from rillspan.operators import decoders, filters, flows, tcp
from rillspan.sources.sinks import SINKS

Transform = Callable[..., DataFrame]


@dataclass
class Decoder:
    """A registered transform: its function, default filter, options and whether it may be followed by another."""

    name: str
    run: Transform
    description: str = ""
    filter: str = ""
    options: dict = field(default_factory=dict)
    chainable: bool = False


DECODERS: dict[str, Decoder] = {}


def register(name: str, description: str = "", filter: str = "", chainable: bool = False, **options):
    """Decorator that adds a transform ``f(df, **options) -> DataFrame``."""

    def add(run: Transform) -> Transform:
        DECODERS[name] = Decoder(name, run, description, filter, options, chainable)
        return run

    return add


def listed() -> list[tuple[str, str, str]]:
    return sorted((d.name, d.description, d.filter) for d in DECODERS.values())


def parse_chain(text: str) -> list[tuple[Decoder, str]]:
    """Steps of a chain with their aliases."""
    steps = []
    for part in text.split("+"):
        name, _, alias = part.strip().partition(":")
        if name not in DECODERS:
            raise ValueError(f"unknown decoder {name!r}")
        steps.append((DECODERS[name], alias or name))
    for decoder, _ in steps[:-1]:
        if not decoder.chainable:
            raise ValueError(f"{decoder.name} can only end a chain")
    return steps


def run_chain(df: DataFrame, text: str, options: dict[str, dict] | None = None, replace: str | None = None, extend: str | None = None, limit: int | None = None, address: Callable | None = None) -> DataFrame:
    """Apply a chain; options are by alias, filters as in ``bpf.combined``.

    ``address`` is a predicate of an address and a port column; a packet passes
    if it holds for either end.
    """
    steps = parse_chain(text)
    if address is not None:
        df = df.filter(address("sip", F.col("sport")) | address("dip", F.col("dport")))
    for decoder, alias in steps:
        given = (options or {}).get(alias, {})
        unknown = set(given) - set(decoder.options)
        if unknown:
            raise ValueError(f"{alias} has no option {sorted(unknown)}")
        expr = bpf.combined(decoder.filter, replace, extend)
        if expr:
            df = df.filter(bpf.compiled(expr))
        df = df.transform(decoder.run, **{**decoder.options, **given})
    df = df.withColumn("decoder", F.lit(steps[-1][1]))
    return df.limit(limit) if limit is not None else df


def write(df: DataFrame, sink: str, *args, **options) -> None:
    if sink not in SINKS:
        raise ValueError(f"unknown sink {sink!r}")
    SINKS[sink](df, *args, **options)


@register("merge", "pass all input on", chainable=True)
def _merge(df: DataFrame) -> DataFrame:
    return df


@register("ip", "one alert per IP packet")
def _ip(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.format_string("%s -> %s", "sip", "dip"))


@register("ether", "one alert per frame")
def _ether(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.format_string("%s->%s %x %d", "smac", "dmac", "ethertype", F.length("payload")))


@register("protocol", "packets other than TCP, UDP and ICMP")
def _protocol(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("proto").isin(1, 6, 17))


@register("country", "flows by country", chainable=True, code="", neither=False, both=False, not_both=False)
def _country(df: DataFrame, code: str, neither: bool, both: bool, not_both: bool) -> DataFrame:
    label = filters.country_label(F.col("clientcc"), F.col("servercc"), code, neither, both, not_both)
    return df.withColumn("match", label).filter(F.col("match").isNotNull()).drop("match")


@register("asn-filter", "flows by network name", chainable=True, asn="")
def _asn(df: DataFrame, asn: str) -> DataFrame:
    return df.filter(filters.asn_match(F.col("clientasn"), F.col("serverasn"), asn).isNotNull())


@register("large-flows", "flows of at least so many MiB", size=1.0)
def _large(df: DataFrame, size: float) -> DataFrame:
    return flows.large_flows(df, size)


@register("long-flows", "flows of at least so many minutes", len=5.0)
def _long(df: DataFrame, len: float) -> DataFrame:  # noqa: A002
    return flows.long_flows(df, len)


@register("snort", "content rules", chainable=True, rules="", mode="any")
def _rules(df: DataFrame, rules: str, mode: str) -> DataFrame:
    return filters.apply_rules(df, [filters.rule_predicate(r) for r in filters.parse_rules(rules)], mode)


@register("grep", "connections whose data matches", chainable=True, expression="", ignorecase=False, invert=False)
def _grep(df: DataFrame, expression: str, ignorecase: bool, invert: bool) -> DataFrame:
    hit = F.coalesce(F.col("data").rlike(("(?i)" if ignorecase else "") + expression), F.lit(False))
    return df.filter(~hit if invert else hit)


@register("web", "HTTP requests and responses", filter="tcp and (port 80 or port 8080 or port 8000)", maxurilen=30)
def _web(df: DataFrame, maxurilen: int) -> DataFrame:
    return decoders.web(df, maxurilen)


@register("httpdump", "HTTP requests by URL, with parameters", filter="tcp and (port 80 or port 8080 or port 8000)", urlfilter="")
def _httpdump(df: DataFrame, urlfilter: str) -> DataFrame:
    return decoders.httpdump(df, urlfilter)


@register("rip-http", "files of HTTP responses", filter="tcp and (port 80 or port 8080 or port 8000)", content_filter="", name_filter="")
def _rip(df: DataFrame, content_filter: str, name_filter: str) -> DataFrame:
    return decoders.rip_http(df, content_filter, name_filter)


@register("flash-detect", "successful flash downloads", filter="tcp and (port 80 or port 8080 or port 8000)")
def _flash(df: DataFrame) -> DataFrame:
    return decoders.flash(df)


@register("ms15-034", "probes for the last byte", filter="tcp and (port 80 or port 8080 or port 8000)")
def _probes(df: DataFrame) -> DataFrame:
    return decoders.range_probes(df)


@register("dns", "DNS questions and answers", filter="udp and port 53", showall=False, show_noanswer=False, only_noanswer=False, show_norequest=False, only_norequest=False)
def _dns(df: DataFrame, showall: bool, **kept: bool) -> DataFrame:
    return decoders.dns_alerts(df, showall, show_all=showall, **kept)


@register("reservedips", "answers in reserved address space", filter="udp and port 53")
def _reserved(df: DataFrame) -> DataFrame:
    return decoders.reserved_answers(df)


@register("innuendo-dns", "tunnels in TXT questions", filter="udp and port 53")
def _innuendo(df: DataFrame) -> DataFrame:
    return decoders.tunnelled(df)


@register("dns-cc", "answers by country", filter="udp and port 53", ranges=None, foreign="US", code="")
def _dns_cc(df: DataFrame, ranges: DataFrame, foreign: str, code: str) -> DataFrame:
    return decoders.answers_by_country(df, ranges, foreign, code)


@register("dns-asn", "answers by network", filter="udp and port 53", ranges=None, code="")
def _dns_asn(df: DataFrame, ranges: DataFrame, code: str) -> DataFrame:
    return decoders.answers_by_country(df, ranges, "", code, "asn")


@register("dhcp", "DHCP messages", filter="udp and port 67")
def _dhcp(df: DataFrame) -> DataFrame:
    return decoders.dhcp_leases(df)


@register("ftp", "FTP transfers", filter="tcp")
def _ftp(df: DataFrame) -> DataFrame:
    return decoders.ftp_transfers(df)


@register("tftp", "TFTP files", filter="udp")
def _tftp(df: DataFrame) -> DataFrame:
    return decoders.tftp_files(df)


@register("smbfiles", "files opened over SMB", filter="tcp and (port 445 or port 139)")
def _smbfiles(df: DataFrame) -> DataFrame:
    return decoders.smb_files(df)


@register("rip-smb-uploads", "files written over SMB", filter="tcp and (port 445 or port 139)")
def _smb_uploads(df: DataFrame) -> DataFrame:
    return decoders.smb_uploads(df)


@register("psexec", "sessions that open a service pipe", filter="tcp and (port 445 or port 139)", pipe="(?i)psexec")
def _psexec(df: DataFrame, pipe: str) -> DataFrame:
    return decoders.psexec_sessions(df, pipe)


@register("netflow", "one record for each connection")
def _netflow(df: DataFrame) -> DataFrame:
    return decoders.netflow(df)


@register("synrst", "refused connection attempts", filter="tcp")
def _synrst(df: DataFrame) -> DataFrame:
    return decoders.synrst(df)


@register("followstream", "connections as transcripts", filter="tcp")
def _follow(df: DataFrame) -> DataFrame:
    return decoders.followstream(df)


@register("stream2dump", "connections with data, blob by blob", filter="tcp")
def _blobs(df: DataFrame) -> DataFrame:
    return decoders.with_connection(tcp.connections(df)).filter("length(data) > 0")


@register("track", "packets of hosts while they talk to a target", chainable=True, target="", source="")
def _track(df: DataFrame, target: str, source: str) -> DataFrame:
    return decoders.tracked_packets(df, target.split(","), source.split(",") if source else None).drop("host").distinct()


@register("xor", "data combined with a key", chainable=True, key=b"", cskey=None, sckey=None, resync=False)
def _xor(df: DataFrame, key: bytes, cskey: bytes | None, sckey: bytes | None, resync: bool) -> DataFrame:
    keys = {"cs": decoders.text.key_bytes(cskey or key), "sc": decoders.text.key_bytes(sckey or key)}
    return decoders.xored(df, keys, resync).drop("data").withColumnRenamed("plain", "data")


@register("writer", "end of a chain: write what arrives", sink="json", path="")
def _writer(df: DataFrame, sink: str, path: str) -> DataFrame:
    write(df, sink, path)
    return df


def run_each(df: DataFrame, names: list[str], options: dict[str, dict] | None = None, cached: bool = False) -> dict[str, DataFrame]:
    """Several decoders over one input; with ``cached`` it is kept for all of them."""
    df = df.persist() if cached else df
    return {name: run_chain(df, name, options) for name in names}


@dataclass
class Handlers:
    """A decoder made of hooks, each a function from a batch to rows of ``schema``.

    ``raw`` sees frames, ``packet`` IP packets, ``udp`` packets with UDP data,
    ``init``, ``connection`` and ``close`` connections (at their start, with what
    they carried, and all of them at the end), ``blob`` runs of one direction.
    ``begin`` and ``end`` run once in each partition.  A connection for which
    ``stop`` (a predicate over its row) holds is followed no further: its blobs
    are left out.
    """

    schema: str
    raw: Callable | None = None
    packet: Callable | None = None
    udp: Callable | None = None
    init: Callable | None = None
    blob: Callable | None = None
    connection: Callable | None = None
    close: Callable | None = None
    begin: Callable | None = None
    end: Callable | None = None
    stop: object = None

    def run(self, packets: DataFrame, frames: DataFrame | None = None, **options) -> DataFrame:
        blobs = tcp.connections(packets, **options)
        records = tcp.connection_records(blobs)
        followed = blobs.filter("data is not null")
        if self.stop is not None:
            stopped = records.filter(self.stop).select("conn_key", "conn_no")
            followed = followed.join(stopped, ["conn_key", "conn_no"], "left_anti")
        seen = {
            "raw": frames, "packet": packets, "udp": packets.filter("proto = 17 and length(payload) > 0"), "init": records.select("conn_key", "conn_no", "client_ip", "client_port", "server_ip", "server_port", "start_us"),
            "blob": followed, "connection": records.filter("client_packets + server_packets > 0"), "close": records,
        }
        found = [self._apply(rows, getattr(self, hook)) for hook, rows in seen.items() if getattr(self, hook) and rows is not None]
        return functools.reduce(DataFrame.unionByName, found)

    def _apply(self, rows: DataFrame, hook: Callable) -> DataFrame:
        begin, end = self.begin, self.end

        def run(batches):
            if begin:
                begin()
            for pdf in batches:
                yield hook(pdf)
            if end:
                end()

        return rows.mapInPandas(run, self.schema)
