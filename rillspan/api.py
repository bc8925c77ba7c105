"""The service's calls as functions: list, search, autocomplete, export.

A corpus is a table of blobs ``service, path, conn, blob_no, direction, start, data``
with text as ISO-8859-1 characters; only payload is indexed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspan.functions.patterns import unescape
from rillspan.operators import search as ops


def list_services(blobs: DataFrame) -> list[str]:
    return [r[0] for r in blobs.select("service").distinct().orderBy("service").collect()]


def streams_of(blobs: DataFrame) -> DataFrame:
    """Each container's payload as one text, blobs in order."""
    parts = F.array_sort(F.collect_list(F.struct("start", "data")))
    return blobs.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("text"))


def parse_request(raw: bytes) -> dict:
    """A request's fields, separated by NULs: skip, begin, end, pattern.

    An empty skip asks for completions.  Skip may be decimal, ``0x`` hexadecimal
    or octal with a leading zero.  A missing separator raises ValueError.
    """
    parts = raw.split(b"\0", 3)
    if len(parts) < 4:
        raise ValueError("a request has four fields")
    skip, begin, end, pattern = parts
    out = {"begin": begin.decode("latin-1") or None, "end": end.decode("latin-1") or None, "pattern": pattern.decode("latin-1")}
    if not skip:
        return out | {"kind": "autocomplete"}
    text = skip.decode("ascii")
    number = int(text, 8) if len(text) > 1 and text[0] == "0" and text[1:].isdigit() else int(text, 0)
    if number < 0:
        raise ValueError("skip must not be negative")
    return out | {"kind": "search", "skip": number}


def answer(blobs: DataFrame, raw: bytes) -> DataFrame:
    """The result rows of one request."""
    request = parse_request(raw)
    streams = streams_of(_chosen(blobs, None))
    want = unescape(request["pattern"]).decode("latin-1")
    within = {"begin": unescape(request["begin"]).decode("latin-1") if request["begin"] else None, "end": unescape(request["end"]).decode("latin-1") if request["end"] else None}
    if request["kind"] == "autocomplete":
        return ops.autocomplete(streams, want, **within)
    return ops.search(streams, want, request["skip"], **within).withColumn("raw_len", F.lit(len(request["pattern"])))


def _chosen(blobs: DataFrame, service: str | None) -> DataFrame:
    chosen = blobs if service is None else blobs.filter(F.col("service") == service)
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.withColumn("at", F.coalesce(F.sum(F.length("data")).over(w), F.lit(0)))


def search(blobs: DataFrame, pattern: str, page: int = 0, service: str | None = None, left: int = 50, right: int = 30) -> DataFrame:
    """A page of hits with their connection and text around them, in order."""
    want = unescape(pattern).decode("latin-1")
    chosen = _chosen(blobs, service)
    hits = ops.search(streams_of(chosen), want, *ops.page_of(page))
    near = ops.offset_to_stream(hits.withColumn("part", F.col("path")).drop("path"), chosen.select(F.col("path").alias("part"), "conn", "blob_no", "direction", "data", F.col("at").alias("start"), (F.col("at") + F.length("data")).alias("stop")))
    inside = F.col("off") - F.col("start")
    before = F.substring(F.col("data"), F.greatest(inside - left, F.lit(0)) + 1, F.least(inside, F.lit(left)))
    after = F.substring(F.col("data"), inside + len(want) + 1, F.lit(right))
    return near.select("rn", F.col("part").alias("path"), "off", "len", "conn", "blob_no", "direction", before.alias("before"), after.alias("after")).orderBy("rn")


def autocomplete(blobs: DataFrame, pattern: str, service: str | None = None) -> DataFrame:
    want = unescape(pattern).decode("latin-1")
    return ops.autocomplete(streams_of(_chosen(blobs, service)), want)


def connection_of(blobs: DataFrame, path: str, offset: int) -> DataFrame:
    """Ordered blobs of the connection that holds a payload offset; LookupError if none does."""
    chosen = _chosen(blobs.filter(F.col("path") == path), None)
    hit = chosen.filter((F.col("at") <= offset) & (F.col("at") + F.length("data") > offset)).select("conn").take(1)
    if not hit:
        raise LookupError(f"offset {offset} lies in no connection of {path}")
    return chosen.filter(F.col("conn") == hit[0][0]).orderBy("blob_no")
