"""Packed binary fields as named values, and back."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack(form: str, names: list[str], data: bytes) -> tuple[dict, bytes]:
    """Named values at the start of the data, and what follows them."""
    size = struct.calcsize(form)
    return dict(zip(names, struct.unpack(form, data[:size]), strict=True)), data[size:]


def pack(form: str, names: list[str], values: dict) -> bytes:
    return struct.pack(form, *(values[n] for n in names))


def uint(data: Column, offset: int, size: int) -> Column:
    """A big-endian unsigned integer inside a binary column, without leaving the JVM."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")
