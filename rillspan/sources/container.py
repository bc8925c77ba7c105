"""Stream containers: all connections of a capture back to back, with an index at the end.

Per connection: number of blobs, client and server address, ports, start time,
the ordinals of its packets, then each blob as direction, length and data.  The
file ends with the byte length of every connection and their number.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspan.operators import tcp
from rillspan.sources import capture

HEAD = struct.Struct("<I4s4sHHI")
BLOBS = (
    "path string, conn long, conn_start long, client_ip string, server_ip string, client_port int, server_port int,"
    " start_s long, blob_no int, direction string, start long, data binary"
)


@dataclass
class Connection:
    client_ip: str
    server_ip: str
    client_port: int
    server_port: int
    start_s: int
    blobs: list[tuple[str, bytes]] = field(default_factory=list)
    ordinals: list[int] = field(default_factory=list)


def piece(c: Connection) -> bytes:
    """One connection's bytes; none for an empty connection, which is not stored."""
    if not sum(len(d) for _, d in c.blobs):
        return b""
    head = HEAD.pack(len(c.blobs), socket.inet_aton(c.client_ip), socket.inet_aton(c.server_ip), c.client_port, c.server_port, c.start_s)
    order = struct.pack(f"<I{len(c.ordinals)}I", len(c.ordinals), *c.ordinals)
    return head + order + b"".join(struct.pack("<cI", b"c" if d == "cs" else b"s", len(x)) + x for d, x in c.blobs)


def trailer(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts)}II", *map(len, parts), len(parts))


def dump(connections: list[Connection]) -> bytes:
    parts = [p for p in map(piece, connections) if p]
    return b"".join(parts) + trailer(parts)


def parse(data: bytes) -> Iterator[tuple[int, Connection, list[int]]]:
    """``offset, connection, offsets of its blobs' data``."""
    count = struct.unpack_from("<I", data, len(data) - 4)[0]
    sizes = struct.unpack_from(f"<{count}I", data, len(data) - 4 - 4 * count)
    at = 0
    for size in sizes:
        n, cip, sip, cport, sport, when = HEAD.unpack_from(data, at)
        k = struct.unpack_from("<I", data, at + HEAD.size)[0]
        ordinals = list(struct.unpack_from(f"<{k}I", data, at + HEAD.size + 4))
        pos, blobs, starts = at + HEAD.size + 4 + 4 * k, [], []
        for _ in range(n):
            side, length = struct.unpack_from("<cI", data, pos)
            starts.append(pos + 5)
            blobs.append(("cs" if side == b"c" else "sc", data[pos + 5 : pos + 5 + length]))
            pos += 5 + length
        yield at, Connection(socket.inet_ntoa(cip), socket.inet_ntoa(sip), cport, sport, when, blobs, ordinals), starts
        at += size


def read_containers(spark: SparkSession, path: str, glob: str = "*.ap", recursive: bool = False) -> DataFrame:
    """Blobs of every container below a path, each at its byte offset in the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parsed(files.select("path", "content"))


def parsed(files: DataFrame) -> DataFrame:
    """Blobs of containers given as ``path, content``."""
    names = [c.split()[0] for c in BLOBS.split(", ")]

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [
                    (name, k, at, c.client_ip, c.server_ip, c.client_port, c.server_port, c.start_s, b, d, s, x)
                    for k, (at, c, starts) in enumerate(parse(content))
                    for b, ((d, x), s) in enumerate(zip(c.blobs, starts, strict=True))
                ]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, BLOBS)


def build(captures: DataFrame, done: DataFrame | None = None, **options) -> DataFrame:
    """Containers ``path, content`` of captures given likewise, but for those whose path is in ``done``.

    Connections are laid out wherever they were put together; only a file's
    finished pieces meet.  IPv6 connections have no place in the format.
    """
    if done is not None:
        captures = captures.join(done.select("path"), "path", "left_anti")
    blobs = tcp.connections(capture.packets(capture.frames_of(captures)), **options).filter("data is not null and not contains(client_ip, ':')")
    conn = ["conn_key", "conn_no", "client_ip", "server_ip", "client_port", "server_port", "start_us"]
    file = F.substring_index(F.split_part("conn_key", F.lit("|"), F.lit(4)), "|", 1)
    whole = blobs.groupBy(*conn).agg(
        F.array_sort(F.collect_list(F.struct("blob_no", "direction", "data"))).alias("blobs"), F.array_sort(F.flatten(F.collect_list("frames"))).alias("ordinals")
    ).withColumn("path", file)

    def lay(batches):
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                one = Connection(c.client_ip, c.server_ip, c.client_port, c.server_port, c.start_us // 1_000_000, [(b["direction"], bytes(b["data"])) for b in c.blobs], list(map(int, c.ordinals)))
                rows.append((c.path, c.start_us, f"{c.conn_key}#{c.conn_no}", piece(one)))
            yield pd.DataFrame(rows, columns=["path", "start_us", "conn", "piece"])

    pieces = whole.mapInPandas(lay, "path string, start_us long, conn string, piece binary").filter("length(piece) > 0")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(x) for x in pdf.sort_values(["start_us", "conn"])["piece"]]
        return pd.DataFrame({"path": [pdf["path"].iloc[0] + ".ap"], "content": [b"".join(parts) + trailer(parts)]})

    return pieces.groupBy("path").applyInPandas(join, "path string, content binary")


def exported(blobs: DataFrame, form: str) -> DataFrame:
    """``path, conn, text``: every connection in one of the export formats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blob_no")
        r = pdf.iloc[0]
        one = Connection(r["client_ip"], r["server_ip"], r["client_port"], r["server_port"], r["start_s"], [(d, bytes(x)) for d, x in zip(pdf["direction"], pdf["data"], strict=True)])
        return pd.DataFrame({"path": [r["path"]], "conn": [r["conn"]], "text": [export(one, form, int(r["conn_start"]), pdf["start"].tolist())]})

    return blobs.groupBy("path", "conn").applyInPandas(run, "path string, conn long, text string")


def export(conn: Connection, form: str, offset: int = 0, starts: list[int] | None = None) -> str:
    """A connection in one of the export formats; ``loc`` gives where each blob's data begins and ends."""
    from rillspan.functions.patterns import escape
    from rillspan.functions.text import c_literal, hex_dump

    if form == "str":
        return "".join(d.decode("latin-1") for _, d in conn.blobs)
    if form == "hex":
        return "\n".join(f"{'->' if d == 'cs' else '<-'}\n{hex_dump(x)}" for d, x in conn.blobs)
    if form == "repr":
        return "\n".join(f"{'->' if d == 'cs' else '<-'} {escape(x, backslash=True)}" for d, x in conn.blobs)
    if form == "c":
        return "\n".join(f"/* {d} */ {c_literal(x)}," for d, x in conn.blobs)
    if form in ("pythonsimple", "pythondiff"):
        # a replay transcript: what to send, and what came back
        keep = conn.blobs if form == "pythondiff" else [b for b in conn.blobs if b[0] == "cs"]
        return "\n".join(f"{'send' if d == 'cs' else 'expect'}({x!r})" for d, x in keep)
    if form == "loc":
        return "\n".join(f"{a}\t{a + len(x)}" for a, (_, x) in zip(starts or [], conn.blobs, strict=True))
    if form == "locconn":
        return f"{offset}\t{conn.client_ip}:{conn.client_port}\t{conn.server_ip}:{conn.server_port}"
    raise ValueError(f"unknown format {form!r}")
