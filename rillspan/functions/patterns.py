"""Byte patterns: escape forms and regular-expression quoting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = re.compile(rb"\\(?:x([0-9A-Za-z]{2})|([0-7]{1,3})|([abtnvfr\\]))", re.S)
_NAMED = {b"a": 7, b"b": 8, b"t": 9, b"n": 10, b"v": 11, b"f": 12, b"r": 13, b"\\": 92}


def _hex_digit(byte: int) -> int:
    return int(chr(byte), 16) if chr(byte) in "0123456789abcdefABCDEF" else 0


def unescape(text: str | bytes) -> bytes:
    """Bytes of a pattern with ``\\xHH``, octal and C escapes; a bad hex digit counts as 0.

    Any other backslash stands for itself.
    """
    raw = text.encode("latin-1") if isinstance(text, str) else text

    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([_hex_digit(m[1][0]) << 4 | _hex_digit(m[1][1])])
        if m[2]:
            return bytes([int(m[2], 8) & 0xFF])
        return bytes([_NAMED[m[3]]])

    return _ESCAPE.sub(one, raw)


def escape(data: bytes, backslash: bool = False) -> str:
    """Printable ASCII kept, other bytes as ``\\xhh``; ``backslash`` also escapes the backslash, which makes it reversible."""
    return "".join(chr(b) if 32 <= b < 127 and not (backslash and b == 92) else f"\\x{b:02x}" for b in data)


def normalise_query(text: str) -> str:
    """Octal and C escapes rewritten as ``\\xHH``, for clients that accept only that form."""
    return "".join(f"\\x{b:02x}" if not 32 <= b < 127 or b == 92 else chr(b) for b in unescape(text))


def quote(literal: str) -> str:
    """A Java regular expression that matches exactly this text."""
    return "".join(f"\\x{{{ord(c):x}}}" if not (c.isascii() and c.isalnum()) else c for c in literal)


def escape_column(text: Column, backslash: bool = False) -> Column:
    """``escape`` for a Latin-1 decoded column, inside the JVM."""
    keep = "[^ -\\[\\]-~]" if backslash else "[^ -~]"
    chars = F.split(text, "")
    hexed = F.transform(
        chars,
        lambda c: F.when(c.rlike(keep), F.concat(F.lit("\\x"), F.lower(F.hex(F.encode(c, "ISO-8859-1"))))).otherwise(c),
    )
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(hexed, ""))
