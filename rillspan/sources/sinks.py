"""Record sinks: a format-string compiler and text, CSV, JSON, XML, flow and session writers."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"%\((\w+)(?::(\w+))?\)([-#0 +]*\d*(?:\.\d+)?)(timestamp|datetime|inet|host|cidr|macaddr|[a-zA-Z])|%%")

# Column types that format characters and names stand for.
SQL_TYPES = {
    "s": "string", "c": "string", "d": "int", "i": "int", "u": "int", "x": "int", "f": "decimal(18,6)", "e": "decimal(18,6)", "g": "decimal(18,6)",
    "b": "boolean", "t": "timestamp", "D": "timestamp", "I": "string", "H": "string", "C": "string", "M": "string",
    "timestamp": "timestamp", "datetime": "timestamp", "inet": "string", "host": "string", "cidr": "string", "macaddr": "string",
}
ARROWS = {"cs": "->", "sc": "<-"}


@dataclass
class Field:
    name: str
    column: str
    spec: str
    kind: str


def parse_format(form: str) -> tuple[str, list[Field]]:
    """A Java format string and its fields, from ``%(name)spec`` or ``%(name:column)type``."""
    fields: list[Field] = []

    def one(m: re.Match) -> str:
        if m[0] == "%%":
            return "%%"
        fields.append(Field(m[1], m[2] or m[1], m[3], m[4]))
        kind = {"i": "d", "u": "d"}.get(m[4], m[4] if m[4] in "sdxfegc" else "s")
        return f"%{m[3]}{kind}"

    return _FIELD.sub(one, form), fields


def _typed(field: Field, null: str, present: bool) -> Column:
    if not present:
        return F.lit(null)
    c = F.col(field.name)
    if field.kind in ("d", "i", "u", "x"):
        return c.cast("long")
    if field.kind in ("f", "e", "g"):
        return c.cast("double")
    return F.coalesce(c.cast("string"), F.lit(null))


def text_lines(df: DataFrame, form: str, null: str = "", keep: list[str] | None = None) -> DataFrame:
    """``line`` of every record; missing fields become the null text."""
    java, fields = parse_format(form)
    columns = [_typed(f, null, f.name in df.columns) for f in fields]
    line = F.format_string(java, *columns) if fields else F.lit(java.replace("%%", "%"))
    return df.select(*(keep or []), line.alias("line"))


def with_extra(df: DataFrame, named: list[str]) -> DataFrame:
    """Named fields plus ``extra``, a map of the rest as text."""
    rest = [c for c in df.columns if c not in named]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*(c for c in named if c in df.columns), extra.alias("extra"))


def json_lines(df: DataFrame, fields: list[str] | None = None, geo: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``line``: a record as a JSON object.

    Without ``fields`` all go, ``ts`` as ``starttime`` and, unless ``geo``,
    without country and network columns.
    """
    if fields is None:
        dropped = set() if geo else {c for c in df.columns if c.endswith(("cc", "asn"))}
        columns = [F.col(c).alias("starttime" if c == "ts" else c) for c in df.columns if c not in dropped and c not in (keep or [])]
    else:
        columns = [F.col(c) for c in fields]
    return df.select(*(keep or []), F.to_json(F.struct(*columns)).alias("line"))


CSV_FIELDS = ["decoder", "datetime", "sip", "sport", "dip", "dport"]


def csv_lines(df: DataFrame, extra: list[str] | None = None, delimiter: str = ",", keep: list[str] | None = None) -> DataFrame:
    """``line``: the default fields, then ``field[:type]`` arguments, as CSV; ``delimiter`` may be ``tab``."""
    options = {"sep": "\t" if delimiter == "tab" else delimiter}
    return df.select(*(keep or []), F.to_csv(F.struct(*_csv_columns(df, extra)), options).alias("line"))


def xml_lines(df: DataFrame, fields: list[str], blobs: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``line``: an ``alert`` element, its fields as attributes, an array of blobs as elements in it."""
    parts = [F.col(c).cast("string").alias(f"_{c}") for c in fields] + ([F.col(blobs).alias("blob")] if blobs else [])
    return df.select(*(keep or []), F.to_xml(F.struct(*parts), {"rowTag": "alert"}).alias("line"))


def _csv_columns(df: DataFrame, extra: list[str] | None) -> list[Column]:
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CSV_FIELDS]
    for spec in extra or []:
        name, _, kind = spec.partition(":")
        c = F.col(name)
        columns.append(c.cast(SQL_TYPES.get(kind, kind)).alias(name) if kind else c)
    return columns


def write_csv(df: DataFrame, path: str, extra: list[str] | None = None, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Default fields, then ``field[:type]`` arguments; ``delimiter`` may be ``tab``."""
    df.select(*_csv_columns(df, extra)).write.mode(mode).csv(path, sep="\t" if delimiter == "tab" else delimiter, header=header)


def write_text(df: DataFrame, path: str, form: str, mode: str = "errorifexists") -> None:
    text_lines(df, form).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    json_lines(df, fields).write.mode(mode).text(path)


def write_xml(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One ``alert`` element a record, its fields as attributes."""
    marked = df.select(*(F.col(c).alias(f"_{c}") for c in df.columns))
    marked.write.mode(mode).format("xml").option("rootTag", "alerts").option("rowTag", "alert").save(path)


def typed_columns(df: DataFrame, form: str) -> DataFrame:
    """Fields of a format as columns of the types that its kinds stand for."""
    _, fields = parse_format(form)
    return df.select(*(F.col(f.name).cast(SQL_TYPES.get(f.kind, "string")).alias(f.column) for f in fields))


def write_jdbc(df: DataFrame, url: str, table: str, form: str, **properties: str) -> None:
    """Fields of a format as typed columns, appended; the table is made if missing."""
    typed_columns(df, form).write.mode("append").jdbc(url, table, properties=properties)


def session_texts(blobs: DataFrame, session: str, order: str, direction: str, data: str, which: str = "both") -> DataFrame:
    """Each session's data in order, per direction with ``split``, or of one direction alone."""
    if which not in ("both", "split", "cs", "sc"):
        raise ValueError("which must be both, split, cs or sc")
    rows = blobs.filter(F.col(direction) == which) if which in ("cs", "sc") else blobs
    parts = [session, direction] if which == "split" else [session]
    return rows.groupBy(*parts).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda x: x[data]), "").alias("value")
    )


def write_sessions(blobs: DataFrame, path: str, session: str, order: str, direction: str, data: str, which: str = "both", mode: str = "errorifexists") -> None:
    """One folder per session (and per direction with ``split``), data in order."""
    parts = [session, direction] if which == "split" else [session]
    joined = session_texts(blobs, session, order, direction, data, which)
    joined.write.mode(mode).partitionBy(*parts).text(path)


def extracted_files(files: DataFrame, name: str = "name", data: str = "data", order: list[str] | None = None) -> DataFrame:
    """Files as ``local_name, md5, size, data``; names are made safe and unique."""
    from rillspan.functions.text import local_filename, unique_filenames

    safe = files.withColumn("_safe", local_filename(F.col(name)))
    return unique_filenames(safe, "_safe", order or [name]).select(
        "local_name", F.md5(data).alias("md5"), F.length(data).cast("long").alias("size"), F.col(data).cast("binary").alias("data")
    )


def write_files(files: DataFrame, path: str, name: str = "name", data: str = "data", order: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Extracted files as a table of ``local_name, md5, size, data``; names are made safe and unique."""
    named = extracted_files(files, name, data, order)
    named.write.mode(mode).parquet(path)
    return files.sparkSession.read.parquet(path)


def write_anonymised(packets: DataFrame, path: str, key: str, network: str = "10.0.0.0/8", mode: str = "errorifexists") -> None:
    """Packets with mapped IPv4 addresses, and beside them the mapping as CSV."""
    from rillspan.functions.net import anonymous_ip, int_to_ip, ip_to_int

    ips = packets.select(F.col("sip").alias("ip")).unionByName(packets.select(F.col("dip").alias("ip"))).distinct()
    number = ip_to_int(F.col("ip"))
    mapping = ips.withColumn("mapped", F.coalesce(int_to_ip(anonymous_ip(number, key, network)), F.substring(F.sha1(F.concat(F.lit(key), F.col("ip"))), 1, 32)))
    src, dst = (mapping.select(F.col("ip").alias(c), F.col("mapped").alias(f"_{c}")) for c in ("sip", "dip"))
    out = packets.join(src, "sip", "left").join(dst, "dip", "left").withColumn("sip", F.col("_sip")).withColumn("dip", F.col("_dip")).select(packets.columns)
    out.write.mode(mode).parquet(f"{path}/packets")
    mapping.write.mode(mode).csv(f"{path}/mapping", header=True)


def flow_lines(flows: DataFrame) -> DataFrame:
    """The fixed-width line of a flow record, countries ``--`` where they are not known."""
    geo = lambda c: F.coalesce(F.col(c), F.lit("--")) if c in flows.columns else F.lit("--")
    form = "%s  %15s -> %15s  (%s -> %s)  %5s %6s %6s %5d %5d %7d %7d %.4fs"
    seconds = F.col("end_time").cast("double") - F.col("start_time").cast("double")
    return flows.select(
        F.format_string(
            form, F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "client_ip", "server_ip", geo("clientcc"), geo("servercc"), "proto", "client_port", "server_port",
            "client_packets", "server_packets", "client_bytes", "server_bytes", seconds,
        ).alias("line")
    )


def transcript(blobs: DataFrame, conn: str, order: str, direction: str, data: str, start: str = "start") -> DataFrame:
    """Ordered ``(arrow, data)`` lines of a connection, with each direction's running offset."""
    arrow = F.when(F.col(direction) == "cs", "->").when(F.col(direction) == "sc", "<-").otherwise("--")
    return blobs.select(conn, order, arrow.alias("arrow"), start, data).orderBy(conn, order)


COLOURS = {"cs": ("31", "#c00"), "sc": ("32", "#080"), "--": ("0", "#000")}


def coloured(direction: str, data: bytes, mode: str = "tty", hexadecimal: bool = False, offset: int = 0) -> str:
    """One blob for a terminal, a page or as plain text."""
    from rillspan.functions.text import hex_dump

    shown = hex_dump(data, offset=offset) if hexadecimal else data.decode("latin-1")
    tty, page = COLOURS.get(direction, COLOURS["--"])
    if mode == "tty":
        return f"\x1b[{tty}m{shown}\x1b[0m"
    if mode == "html":
        return f'<span style="color:{page}">{html.escape(shown)}</span>'
    return shown


SINKS = {"text": write_text, "csv": write_csv, "json": write_json, "xml": write_xml, "jdbc": write_jdbc, "session": write_sessions, "files": write_files}


def coloured_column(direction: Column, data: Column, mode: str = "html") -> Column:
    """``coloured`` over a table: text of each blob in the colour of its direction."""

    @F.pandas_udf("string")
    def run(d: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else coloured(a, bytes(b), mode) for a, b in zip(d, x, strict=True)], dtype=object)

    return run(direction, data)
