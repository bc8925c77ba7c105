"""Connections from packets: the TCP state machine and UDP pseudo-connections."""

from __future__ import annotations

from collections import namedtuple
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIN, SYN, RST, ACK = 1, 2, 4, 16
MASK = 0xFFFFFFFF
BLOBS = (
    "conn_key string, conn_no int, client_ip string, client_port int, server_ip string, server_port int, proto int, start_us long, end_us long,"
    " state string, blob_no int, direction string, blob_start_us long, blob_end_us long, data binary, has_gap boolean, frames array<long>"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(n, _KINDS[kind]) for n, kind in (c.split() for c in BLOBS.split(", "))])
Packet = namedtuple("Packet", "frame_no ts_us sip sport dip dport proto flags seq ack payload")


@dataclass
class Blob:
    direction: str
    start_us: int
    end_us: int
    segments: dict[int, list[bytes]] = field(default_factory=dict)
    frames: list[int] = field(default_factory=list)


def laid(segments: dict[int, list[bytes]], base: int, gaps: str = "pad", fill: bytes = b"\x00", latest: bool = True, overlap: bool = False) -> tuple[bytes, bool]:
    """Data of segments by sequence offset, and whether anything was missing.

    Offsets count from ``base`` modulo 2^32, so a wrapped stream stays in order.
    With ``overlap`` new data replaces what it covers, else what is laid stays.
    """
    out, gap = bytearray(), False
    start = None
    for off in sorted(segments, key=lambda o: (o - base) & MASK):
        data = segments[off][-1 if latest else 0]
        at = (off - base) & MASK
        if start is None:
            start = at
        at -= start
        if at > len(out):
            gap = True
            if gaps == "error":
                raise ValueError(f"{at - len(out)} bytes are missing at {len(out)}")
            if gaps == "pad":
                out += fill * (at - len(out))
            else:
                start += at - len(out)
                at = len(out)
        if overlap:
            out[at : at + len(data)] = data
        elif at + len(data) > len(out):
            out += data[len(out) - at :]
    return bytes(out), gap


class Tracker:
    """Packets of one endpoint pair, in time order, to connections and blobs; ``taken`` counts connections whose rows were given out."""

    def __init__(self, idle_us: int, ignore_handshake: bool, gaps: str, max_blobs: int | None = None):
        self.idle_us, self.ignore_handshake, self.gaps, self.max_blobs = idle_us, ignore_handshake, gaps, max_blobs
        self.done: list[dict] = []
        self.now: dict | None = None
        self.taken = 0

    def _open(self, p, state: str) -> None:
        client, server = (p.sip, p.sport), (p.dip, p.dport)
        if p.proto == 17 and p.sport < p.dport:
            client, server = server, client
        self.now = {"client": client, "server": server, "proto": p.proto, "start": p.ts_us, "end": p.ts_us,
                    "state": state, "isn": {}, "blobs": []}

    def close(self, state: str | None = None) -> None:
        if self.now:
            self.now["state"] = state or self.now["state"]
            self.done.append(self.now)
        self.now = None

    def _data(self, p) -> None:
        c = self.now
        side = "cs" if (p.sip, p.sport) == c["client"] else "sc"
        if not c["blobs"] or c["blobs"][-1].direction != side:
            if self.max_blobs and len(c["blobs"]) >= self.max_blobs:
                self.close("rollover")
                self._open(p, "established")
                c, side = self.now, "cs"
            c["blobs"].append(Blob(side, p.ts_us, p.ts_us))
        blob = c["blobs"][-1]
        blob.end_us = p.ts_us
        blob.segments.setdefault(int(p.seq) if p.seq is not None and p.seq == p.seq else sum(len(s[-1]) for s in blob.segments.values()), []).append(p.payload)
        blob.frames.append(p.frame_no)

    def packet(self, p) -> None:
        if self.now and p.ts_us - self.now["end"] > self.idle_us:
            self.close("timeout")
        if p.proto == 17:
            if not self.now:
                self._open(p, "established")
            self.now["end"] = p.ts_us
            if p.payload:
                self._data(p)
            return
        flags = int(p.flags or 0)
        bare = flags & (FIN | SYN | RST | ACK)
        if bare == SYN:
            if self.now and self.now["state"] == "established":
                self.close("replaced")
            if not self.now:
                self._open(p, "init")
                self.now["isn"]["cs"] = int(p.seq)
            return
        if bare == SYN | ACK:
            c = self.now
            if c and c["state"] == "init" and (int(p.ack) - 1) & MASK == c["isn"].get("cs"):
                c["state"], c["end"] = "established", p.ts_us
                c["isn"]["sc"] = int(p.seq)
            return
        if not self.now and self.ignore_handshake and p.payload:
            self._open(p, "established")
        if not self.now:
            return
        self.now["end"] = p.ts_us
        if p.payload and (self.now["state"] == "established" or self.ignore_handshake):
            self.now["state"] = "established"
            self._data(p)
        if flags & (FIN | RST):
            self.close("closed" if flags & FIN else "reset")

    def rows(self, key: str) -> list[tuple]:
        """Rows of the connections that were closed since the last call."""
        out = []
        for n, c in enumerate(self.done, self.taken):
            head = (key, n, *c["client"], *c["server"], c["proto"], c["start"], c["end"], c["state"])
            for b, blob in enumerate(c["blobs"]):
                data, gap = laid(blob.segments, next(iter(blob.segments)) - (1 << 31), self.gaps)
                out.append((*head, b, blob.direction, blob.start_us, blob.end_us, data, gap, blob.frames))
            if not c["blobs"]:
                out.append((*head, None, None, None, None, None, False, []))
        self.taken += len(self.done)
        self.done = []
        return out


def whole(packets: DataFrame, gap_s: float = 30) -> DataFrame:
    """Packets with fragmented ones put together; those of which a part is missing go.

    Fragments meet by addresses, protocol and number, no further apart than
    ``gap_s``, as numbers are used again.  Tables without fragments' columns pass.
    """
    if not {"more_fragments", "ip_id"} <= set(packets.columns):
        return packets
    columns = packets.columns
    key = ["file", "sip", "dip", "proto", "ip_id"]
    cut = F.coalesce(F.col("more_fragments") | (F.col("frag_offset") > 0), F.lit(False))
    marked = packets.withColumn("_cut", F.when(cut, F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))))
    # one pass: a branch for fragments would read and parse all frames a second time
    spread = marked.repartition(F.coalesce("_cut", F.concat_ws("|", *(c for c in ("sip", "sport", "dip", "dport") if c in columns))))
    placed = spread.sortWithinPartitions("_cut", *(F.when(F.col("_cut").isNotNull(), F.col(c)) for c in ("ts_us", "frame_no")))

    def run(batches):
        name, parts = None, []
        for batch in batches:
            schema, keys = batch.schema.remove(batch.schema.get_field_index("_cut")), batch.column("_cut")
            rows = batch.select(columns)
            if keys.null_count == len(keys):
                yield rows
                continue
            if keys.null_count:
                yield rows.filter(keys.is_null())
            made = []
            for k, row in zip(keys.drop_null().to_pylist(), rows.filter(keys.is_valid()).to_pylist(), strict=True):
                if parts and (k != name or row["ts_us"] - parts[-1]["ts_us"] > gap_s * 1e6):
                    made += _joined(parts)
                    parts = []
                name = k
                parts.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
        if parts and (made := _joined(parts)):
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return placed.mapInArrow(run, packets.schema)


def _joined(parts: list[dict]) -> list[dict]:
    """The packet that fragments make, none where a part is missing; of parts at one place the first counts."""
    at: dict[int, dict] = {}
    for p in parts:
        at.setdefault(p["frag_offset"], p)
    first, *rest = (at[k] for k in sorted(at))
    if not rest or first["frag_offset"] or rest[-1]["more_fragments"]:
        return []
    # the transport header of the first fragment is parsed already; it is as long as what its data lacks
    head, end = rest[0]["frag_offset"] - len(first["payload"]), rest[0]["frag_offset"]
    if not (head == 8 if first["proto"] == 17 else 20 <= head <= 60 if first["proto"] == 6 else head == 0):
        return []
    for p in rest:
        if p["frag_offset"] != end:
            return []
        end += len(p["payload"])
    return [first | {"payload": b"".join(p["payload"] for p in (first, *rest)), "frag_offset": 0, "more_fragments": False}]


def connections(packets: DataFrame, idle_tcp_s: float = 300, idle_udp_s: float = 60, ignore_handshake: bool = False, gaps: str = "pad", max_blobs: int | None = None) -> DataFrame:
    """Blobs of every connection; one without data has one row with a null blob.

    Fragments are put together first.  Packets meet by their unordered
    endpoints, so both directions are together.  A UDP exchange's server is the
    side with the lower port.
    A task reads pair after pair in time order and gives a connection out once it
    is closed, so it holds one connection, not all that two machines ever said;
    idle gaps start a new spell of the pair.
    """
    a, b = F.concat_ws(":", "sip", "sport"), F.concat_ws(":", "dip", "dport")
    keyed = whole(packets.filter(F.col("proto").isin(6, 17))).withColumn(
        "_pair", F.concat_ws("|", F.least(a, b), F.greatest(a, b), "proto", "file")
    )

    def run(batches):
        """Packets come pair by pair in time order, so one connection at a time is open."""
        pair = tracker = None
        spell, last, idle, rows, held = 0, 0, 0, [], 0

        def ended(state: str | None) -> int:
            tracker.close(state)
            return take()

        def take() -> int:
            new = tracker.rows(f"{pair}|{spell}")
            rows.extend(new)
            return sum(len(r[14] or b"") + 500 for r in new)

        def begin(udp: bool) -> Tracker:
            return Tracker(idle, ignore_handshake, gaps, max_blobs or (2 if udp else None))

        for batch in batches:
            for key, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = Packet._make(fields)
                if key != pair:
                    if tracker:
                        held += ended(None)
                    pair, spell, udp = key, 0, p.proto == 17
                    idle = int(1e6 * (idle_udp_s if udp else idle_tcp_s))
                    tracker = begin(udp)
                elif p.ts_us - last > idle:
                    held += ended("timeout")
                    spell, tracker = spell + 1, begin(udp)
                last = p.ts_us
                tracker.packet(p)
                if tracker.done:
                    held += take()
                if held > 1 << 23:
                    yield _batch(rows)
                    rows, held = [], 0
        if tracker:
            ended(None)
        if rows:
            yield _batch(rows)

    placed = keyed.select("_pair", *Packet._fields).repartition("_pair").sortWithinPartitions("_pair", "ts_us", "frame_no")
    return placed.mapInArrow(run, BLOBS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def connection_records(blobs: DataFrame) -> DataFrame:
    """One row per connection with its counters."""
    size = lambda d: F.sum(F.when(F.col("direction") == d, F.length("data")).otherwise(0))
    n = lambda d: F.sum(F.when(F.col("direction") == d, F.size("frames")).otherwise(0))
    return blobs.groupBy("conn_key", "conn_no", "client_ip", "client_port", "server_ip", "server_port", "proto", "start_us", "end_us", "state").agg(
        n("cs").alias("client_packets"), n("sc").alias("server_packets"), size("cs").alias("client_bytes"), size("sc").alias("server_bytes")
    )
