"""Text of protocols: parameters, headers, cookies, dumps, digests."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_parameters(query: Column) -> Column:
    """Map of a query string, values decoded; null where it holds a space."""
    pairs = F.str_to_map(query, F.lit("&"), F.lit("="))
    decoded = F.transform_values(pairs, lambda _, v: F.try_url_decode(v))
    return F.when(query.isNotNull() & ~F.contains(query, F.lit(" ")), decoded)


def cookies(header: Column) -> Column:
    return F.transform_values(F.str_to_map(header, F.lit("; "), F.lit("=")), lambda _, v: F.try_url_decode(v))


def header(headers: Column, name: str) -> Column:
    """A header by name in any case, values of repeats joined by ``, ``, '' if absent.

    ``headers`` is an array of (name, value).
    """
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.array_join(F.transform(hit, lambda h: h["value"]), ", ")


def last_modified(headers: Column) -> Column:
    """The Last-Modified time, else the Date, as a timestamp."""

    def parse(name: str) -> Column:
        without_day = F.regexp_replace(header(headers, name), "^[A-Za-z]+, ", "")
        return F.try_to_timestamp(without_day, F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))

    return F.coalesce(parse("last-modified"), parse("date"))


def truncated(uri: Column, length: int) -> Column:
    cut = F.concat(F.substring(uri, 1, length), F.lit("[truncated]"))
    return F.when(F.length(uri) > length, cut).otherwise(uri)


def has_magic(body: Column, *magics: str) -> Column:
    cond = F.lit(False)
    for m in magics:
        cond = cond | F.startswith(body, F.lit(m))
    return cond


def payload_md5(data: Column) -> Column:
    """MD5 without trailing NULs."""
    return F.md5(F.regexp_replace(data, "\\x00+$", ""))


def access_mode(reads: Column, writes: Column) -> Column:
    return F.when((reads > 0) & (writes > 0), "B").when(reads > 0, "R").when(writes > 0, "W").otherwise("-")


def printable(text: Column, replacement: str = ".") -> Column:
    return F.regexp_replace(text, "[^ -~\\n\\r\\t]", replacement)


def printable_unicode(text: Column) -> Column:
    """Control characters dropped."""
    return F.regexp_replace(text, "\\p{Cntrl}", "")


def multipart_file(body: Column) -> Column:
    """Content type, file name and data of the first file of a multipart body."""
    data = F.regexp_extract(body, "(?s)filename=\"[^\"]*\".*?\\r?\\n\\r?\\n(.*?)\\r?\\n--", 1)
    kind = F.regexp_extract(body, "(?i)content-type:\\s*([^\\r\\n]+)", 1)
    return F.struct(kind.alias("content_type"), F.regexp_extract(body, "filename=\"([^\"]*)\"", 1).alias("filename"), data.alias("data"))


def multipart_files(body: Column) -> Column:
    """Content type, file name and data of every file of a multipart body."""
    rest = F.transform(F.slice(F.split(body, "filename=\""), 2, 1 << 20), lambda p: F.concat(F.lit("filename=\""), p))
    return F.transform(rest, lambda p: multipart_file(F.concat(p, F.lit("\r\n--"))))


def local_filename(name: Column) -> Column:
    """A name without separators; what is not printable becomes %XX."""
    chars = F.split(F.regexp_replace(name, "[\\\\/: ]", "_"), "")
    safe = F.transform(chars, lambda c: F.when(c.rlike("^[ -~]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.array_join(safe, "")


def unique_filenames(df: DataFrame, column: str, order: list[str], out: str = "local_name") -> DataFrame:
    """Add a name that no other row has: repeats get ``_01``, ``_02`` ..."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(column)).otherwise(F.concat(F.col(column), F.lit("_"), F.lpad(n.cast("string"), 2, "0"))))


def pasv_endpoint(line: Column) -> Column:
    """``ip, port`` of a passive or active announcement ``a,b,c,d,p1,p2``."""
    rx = r"(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)"
    part = [F.regexp_extract(line, rx, n) for n in range(1, 7)]
    port = part[4].try_cast("int") * 256 + part[5].try_cast("int")
    return F.when(line.rlike(rx), F.struct(F.concat_ws(".", *part[:4]).alias("ip"), port.alias("port")))


def epsv_port(line: Column) -> Column:
    return F.regexp_extract(line, r"\|\|\|(\d+)\|", 1).try_cast("int")


def base64_with(text: Column, alphabet: str, pad: str = "=") -> Column:
    """Bytes of base64 in another alphabet; null where a foreign character occurs."""
    standard = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return F.try_to_binary(F.translate(text, alphabet + pad, standard + "="), F.lit("base64"))


def symbol_table(df: DataFrame, column: str) -> DataFrame:
    """``symbol, n, below``: counts with the number of smaller symbols."""
    counted = df.select(F.explode(F.split(column, "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("below", F.coalesce(below, F.lit(0)).cast("long"))


# ---------------------------------------------------------------- bytes at the edge of a query


def xor_bytes(data: bytes, key: bytes) -> bytes:
    """Data combined with a repeating key."""
    if not key:
        return data
    whole = (key * (len(data) // len(key) + 1))[: len(data)]
    return (int.from_bytes(data, "big") ^ int.from_bytes(whole, "big")).to_bytes(len(data), "big") if data else b""


def key_bytes(key) -> bytes:
    """A key given as bytes, a number, ``0x`` hexadecimal or quoted text."""
    if isinstance(key, bytes):
        return key
    if isinstance(key, int):
        return bytes([key & 255])
    if key.startswith("0x"):
        return bytes.fromhex(key[2:])
    if key[:1] in "\"'" and key[-1:] == key[:1]:
        return key[1:-1].encode("latin-1")
    return bytes([int(key) & 255]) if key.isdigit() else key.encode("latin-1")


def hex_dump(data: bytes, width: int = 16, offset: int = 0) -> str:
    """Offset, hexadecimal and printable columns."""
    lines = []
    for at in range(0, len(data), width):
        row = data[at : at + width]
        shown = "".join(chr(b) if 32 <= b < 127 else "." for b in row)
        lines.append(f"{offset + at:08x}  {' '.join(f'{b:02x}' for b in row):<{3 * width - 1}}  {shown}")
    return "\n".join(lines)


def c_literal(data: bytes) -> str:
    """A C string literal; a hex escape is closed before a hex digit follows."""
    out, after_hex = [], False
    for b in data:
        c = chr(b)
        if b in (34, 92):
            out.append("\\" + c)
            after_hex = False
        elif 32 <= b < 127:
            out.append('""' + c if after_hex and c in "0123456789abcdefABCDEF" else c)
            after_hex = False
        else:
            out.append(f"\\x{b:02x}")
            after_hex = True
    return '"' + "".join(out) + '"'


def base64_decode(text: str) -> bytes | None:
    try:
        return base64.b64decode(text, validate=True)
    except ValueError:
        return None


def over_bytes(one):
    """A column function that applies a function of bytes to text in Arrow batches."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else one(bytes(x)))

    return run


def strtok(text: Column, between: str = ";", within: str = "=") -> Column:
    """Words of a text, and a map of those of the form key = value."""
    words = F.filter(F.transform(F.split(text, between), lambda w: F.trim(w)), lambda w: w != "")
    pairs = F.filter(words, lambda w: F.contains(w, F.lit(within)))
    keyed = F.map_from_entries(F.transform(pairs, lambda w: F.struct(F.trim(F.split_part(w, F.lit(within), F.lit(1))), F.trim(F.substring(w, F.instr(w, within) + F.lit(len(within)), F.length(w))))))
    return F.struct(F.filter(words, lambda w: ~F.contains(w, F.lit(within))).alias("words"), keyed.alias("pairs"))
