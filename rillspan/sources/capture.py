"""Packet captures: classic and next-generation files, compressed or not, as tables of frames and packets."""

from __future__ import annotations

import bz2
import gzip
import io
import ipaddress
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "file string, frame_no long, ts_us long, linktype int, raw binary"
PACKETS = (
    "file string, frame_no long, ts_us long, smac string, dmac string, vlan int, ethertype int, version int, sip string, dip string,"
    " proto int, ip_id int, frag_offset int, more_fragments boolean, sport int, dport int, flags int, seq long, ack long, payload binary"
)
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def expanded(data: bytes, name: str = "") -> bytes:
    """Contents of a .gz, .bz2 or .zip file (of an archive the first member), else the data."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(z.namelist()[0])
    return data


def frames(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """``frame_no, ts_us, linktype, raw`` of a capture; a truncated last record is left out."""
    magic = data[:4]
    for order in "<>":
        if len(data) >= 24 and struct.unpack(order + "I", magic)[0] in (0xA1B2C3D4, 0xA1B23C4D):
            return _classic(data, order)
    if magic == b"\x0a\x0d\x0d\x0a":
        return _blocks(data)
    raise ValueError("not a capture file")


def _classic(data: bytes, order: str):
    nano = struct.unpack_from(order + "I", data)[0] == 0xA1B23C4D
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at, n = 24, 0
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + size > len(data):
            return
        yield n, sec * 1_000_000 + (frac // 1000 if nano else frac), link, data[at + 16 : at + 16 + size]
        at, n = at + 16 + size, n + 1


def _options(data: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0:
            break
        out[code] = data[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
    return out


def _blocks(data: bytes):
    order, faces, at, n = "<", [], 0, 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":  # a section names its byte order and starts its interfaces
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            faces = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == 1:
            link, _, snap = struct.unpack_from(order + "HHI", body)
            opts = _options(body[8:], order)
            res = opts.get(9, b"\x06")[0]
            per = 2 ** (res & 0x7F) if res & 0x80 else 10**res
            shift = struct.unpack(order + "q", opts[14])[0] if 14 in opts else 0
            faces.append((link, per, shift, snap))
        elif kind == 6 and faces:
            face, hi, lo, cap, _ = struct.unpack_from(order + "IIIII", body)
            link, per, shift, _ = faces[face]
            yield n, ((hi << 32 | lo) * 1_000_000) // per + shift * 1_000_000, link, body[20 : 20 + cap]
            n += 1
        elif kind == 3 and faces:
            whole = struct.unpack_from(order + "I", body)[0]
            link, _, _, snap = faces[0]
            yield n, 0, link, body[4 : 4 + min(whole, snap or whole)]
            n += 1
        # any other block is passed over by its length


def _mac(raw: bytes) -> str:
    return ":".join(f"{b:02x}" for b in raw)


def parse_packet(raw: bytes, linktype: int = 1, strip: int = 0) -> dict | None:
    """Fields of one frame, None where it is cut short or not IP; ``strip`` drops inner IP layers."""
    out: dict = {"smac": None, "dmac": None, "vlan": None, "ethertype": None}
    at = 0
    if linktype == 1:
        if len(raw) < 14:
            return None
        out["dmac"], out["smac"] = _mac(raw[:6]), _mac(raw[6:12])
        kind, at = struct.unpack_from("!H", raw, 12)[0], 14
        while kind in (0x8100, 0x88A8) and len(raw) >= at + 4:
            tag, kind = struct.unpack_from("!HH", raw, at)
            out["vlan"], at = tag & 0xFFF, at + 4
        out["ethertype"] = kind
    elif linktype == 113:
        if len(raw) < 16:
            return None
        out["ethertype"], at = struct.unpack_from("!H", raw, 14)[0], 16
    elif linktype not in (12, 101, 228, 229):
        return None
    while True:
        if len(raw) < at + 20:
            return None
        version = raw[at] >> 4
        if version == 4:
            size = (raw[at] & 15) * 4
            total, ip_id, frag = struct.unpack_from("!HHH", raw, at + 2)
            proto, src, dst = raw[at + 9], raw[at + 12 : at + 16], raw[at + 16 : at + 20]
            out |= {"ip_id": ip_id, "frag_offset": (frag & 0x1FFF) * 8, "more_fragments": bool(frag & 0x2000)}
            end = min(len(raw), at + (total or len(raw)))
        elif version == 6 and len(raw) >= at + 40:
            size, proto = 40, raw[at + 6]
            src, dst = raw[at + 8 : at + 24], raw[at + 24 : at + 40]
            out |= {"ip_id": None, "frag_offset": 0, "more_fragments": False}
            end = min(len(raw), at + 40 + struct.unpack_from("!H", raw, at + 4)[0])
            while proto in (0, 43, 60) and len(raw) >= at + size + 8:  # extension headers
                proto, size = raw[at + size], size + 8 + raw[at + size + 1] * 8
        else:
            return None
        out |= {"version": version, "sip": str(ipaddress.ip_address(src)), "dip": str(ipaddress.ip_address(dst)), "proto": proto}
        body = raw[at + size : end]
        # tunnels: IPv4 in IP, IPv6 in IPv4
        if proto in (4, 41) and (strip > 0 or (proto == 41 and version == 4)):
            at, strip = at + size, strip - 1
            continue
        break
    out |= {"sport": None, "dport": None, "flags": None, "seq": None, "ack": None, "payload": body}
    if out["frag_offset"] == 0:
        if proto == 6 and len(body) >= 20:
            sport, dport, seq, ack, offset, flags = struct.unpack_from("!HHIIBB", body)
            out |= {"sport": sport, "dport": dport, "seq": seq, "ack": ack, "flags": flags, "payload": body[(offset >> 4) * 4 :]}
        elif proto == 17 and len(body) >= 8:
            sport, dport, size = struct.unpack_from("!HHH", body)
            out |= {"sport": sport, "dport": dport, "payload": body[8 : max(8, size)]}
    return out


def read_frames(spark: SparkSession, path: str, glob: str = "*.cap*", recursive: bool = False) -> DataFrame:
    """Frames of every capture below a path, from any store that Spark reads; one file is one task's row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)

    return _frames_of(files)


def _frames_of(files: DataFrame) -> DataFrame:
    """Frames of ``path, content``; with ``first`` the number of a content's first frame, else from 0."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["file", "frame_no", "ts_us", "linktype", "raw"])

    def run(batches):
        for batch in batches:
            for name, content, first in zip(*batch.columns, strict=True):
                name, first, part = name.as_py(), first.as_py(), []
                for n, ts, link, raw in frames(expanded(content.as_py(), name)):
                    part.append((name, first + n, ts, link, raw))
                    if len(part) == 5000:
                        yield batch_of(part)
                        part = []
                if part:
                    yield batch_of(part)

    first = F.col("first") if "first" in files.columns else F.lit(0)
    return files.select("path", "content", first.cast("long").alias("first")).mapInArrow(run, FRAMES)


def watch_frames(spark: SparkSession, path: str, glob: str = "*.cap*") -> DataFrame:
    """Frames of captures as they are moved into a folder: a live source over rotated files."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", glob).load(path)
    return _frames_of(files)


_NAMES = [c.split()[0] for c in PACKETS.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _KINDS[kind]) for n, kind in (c.split() for c in PACKETS.split(", "))])
_HEAD = struct.Struct("!6s6sHBxHHHxBxx4s4s")  # an Ethernet header and an IPv4 header without options


def _row(raw: bytes, linktype: int, strip: int, macs: dict[bytes, str]) -> tuple | None:
    """``parse_packet`` as a tuple in the order of ``PACKETS`` from ``smac`` on; TCP and UDP in plain IPv4 by the shortest way."""
    if linktype == 1 and len(raw) >= 34:
        dmac, smac, kind, size, total, ip_id, frag, proto, src, dst = _HEAD.unpack_from(raw)
        if kind == 0x0800 and size == 0x45 and proto in (6, 17):
            if len(macs) > 4096:
                macs.clear()
            for mac in (dmac, smac):
                if mac not in macs:
                    macs[mac] = _mac(mac)
            head = (macs[smac], macs[dmac], None, kind, 4, "%d.%d.%d.%d" % tuple(src), "%d.%d.%d.%d" % tuple(dst), proto, ip_id, (frag & 0x1FFF) * 8, bool(frag & 0x2000))
            end = min(len(raw), 14 + (total or len(raw)))
            if not frag & 0x1FFF:
                if proto == 6 and end >= 54:
                    sport, dport, seq, ack, offset, flags = _TCP.unpack_from(raw, 34)
                    return (*head, sport, dport, flags, seq, ack, raw[34 + (offset >> 4) * 4 : end])
                if proto == 17 and end >= 42:
                    sport, dport, size = _UDP.unpack_from(raw, 34)
                    return (*head, sport, dport, None, None, None, raw[42 : min(end, 34 + max(8, size))])
            return (*head, None, None, None, None, None, raw[34:end])
    got = parse_packet(raw, linktype, strip)
    return got and tuple(got[n] for n in _NAMES[3:])


_TCP, _UDP = struct.Struct("!HHIIBB"), struct.Struct("!HHH")


def packets(frames_: DataFrame, strip: int = 0) -> DataFrame:
    """IP packets of frames; frames that cannot be read drop out."""

    def run(batches):
        macs: dict[bytes, str] = {}
        for batch in batches:
            rows = []
            for f, n, ts, link, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = raw and _row(raw, link, strip, macs)
                if got:
                    rows.append((f, n, ts, *got))
            columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    return frames_.select("file", "frame_no", "ts_us", "linktype", "raw").mapInArrow(run, PACKETS)


def frames_of(files: DataFrame) -> DataFrame:
    """Frames of captures given as ``path, content``."""
    return _frames_of(files)


def as_captures(frames_: DataFrame, part_bytes: int = 1 << 24) -> DataFrame:
    """``path, part, first, content``: captures of each ``file``'s frames in order of time.

    A file of more than ``part_bytes`` comes as several captures, so no task
    holds it whole: ``part`` counts them from 0 and ``first`` is the number of
    their first frame in the file, by which ``frames_of`` numbers frames as in one.
    """
    w = Window.partitionBy("file").orderBy("ts_us", "frame_no").rowsBetween(Window.unboundedPreceding, 0)
    named = frames_.withColumns({"part": F.floor(F.sum(F.length("raw") + 16).over(w) / part_bytes).cast("int"), "_n": F.count("*").over(w) - 1})

    def run(batches):
        now, records, link, first = None, [], 1, 0

        def made() -> pa.RecordBatch:
            content = write_capture(records, link)
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([first], pa.int64()), pa.array([content], pa.binary())], names=["path", "part", "first", "content"])

        for batch in batches:
            for file, part, n, ts, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, part) != now:
                    if now:
                        yield made()
                    now, records, link, first = (file, part), [], kind, n
                records.append((ts, raw))
        if now:
            yield made()

    placed = named.select("file", "part", "_n", "ts_us", "linktype", "raw").repartition("file", "part").sortWithinPartitions("file", "part", "_n")
    return placed.select("file", "part", "_n", "ts_us", "linktype", "raw").mapInArrow(run, "path string, part int, first long, content binary")


def write_capture(records: list[tuple[int, bytes]], linktype: int = 1) -> bytes:
    """A classic capture file of ``(ts_us, raw)`` records."""
    head = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, linktype)
    return head + b"".join(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(r), len(r)) + r for t, r in records)


class CaptureSource(DataSource):
    """``spark.read.format("pcap").load(path)`` for folders mounted on every machine: one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/*") if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition(f) for f in found if os.path.isfile(f)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = expanded(f.read(), partition.value)
        for n, ts, link, raw in frames(data):
            yield partition.value, n, ts, link, raw


def select_frames(frames_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames whose ordinals a connection lists: ``wanted`` has ``file, frame_no``."""
    return frames_.join(wanted.select("file", "frame_no").distinct(), ["file", "frame_no"], "left_semi")


def file_counts(frames_: DataFrame) -> DataFrame:
    return frames_.groupBy("file").agg(F.count("*").alias("packets"), F.sum(F.length("raw")).alias("bytes"))
