"""Capture-filter expressions compiled to column predicates."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\(|\)|!|&&|\|\||[^\s()!]+)")
_PROTO = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}


def read_expression(text: str) -> str:
    """An expression from a file's text: comments end at the line, lines join."""
    return " ".join(line.split("#")[0].strip() for line in text.splitlines()).strip()


def combined(default: str, replace: str | None = None, extend: str | None = None, vlan: bool = True) -> str:
    """A decoder's filter after user options; an extension that starts with ``or`` widens it."""
    expr = replace if replace is not None else default
    if extend:
        if not expr:
            expr = re.sub(r"^or\s+", "", extend)
        elif extend.startswith("or "):
            expr = f"({expr}) {extend}"
        else:
            expr = f"({expr}) and ({extend})"
    return f"({expr}) or (vlan and ({expr}))" if expr and vlan else expr


class _Parser:
    def __init__(self, text: str):
        self.tokens = _TOKEN.findall(text)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1].lower()

    def either(self) -> Column:
        left = self.both()
        while self.peek() in ("or", "||"):
            self.take()
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.one()
        while self.peek() in ("and", "&&"):
            self.take()
            left = left & self.one()
        return left

    def one(self) -> Column:
        word = self.take()
        if word in ("not", "!"):
            return ~self.one()
        if word == "(":
            inner = self.either()
            if self.take() != ")":
                raise ValueError("a parenthesis is not closed")
            return inner
        return self.primitive(word)

    def primitive(self, word: str) -> Column:
        proto: Column | None = None
        if word in _PROTO:
            proto = F.col("proto") == _PROTO[word]
            if self.peek() not in ("port", "portrange", "src", "dst"):
                return proto
            word = self.take()
        elif word in ("ip", "ip6"):
            version = F.col("version") == (4 if word == "ip" else 6)
            if self.peek() not in ("host", "net", "src", "dst"):
                return version
            return version & self.primitive(self.take())
        elif word == "vlan":
            if (self.peek() or "").isdigit():
                return F.col("vlan") == int(self.take())
            return F.col("vlan").isNotNull()
        elif word in ("less", "greater"):
            n = int(self.take())
            return F.length("payload") <= n if word == "less" else F.length("payload") >= n
        side = None
        if word in ("src", "dst"):
            side, word = word, self.take()
        if word in ("port", "portrange"):
            lo, _, hi = self.take().partition("-")
            test = lambda c: F.coalesce(F.col(c).between(int(lo), int(hi or lo)), F.lit(False))
            found = self._sides(side, test, "sport", "dport")
        elif word == "net":
            net = ipaddress.ip_network(self.take(), strict=False)
            from rillspan.functions.net import in_cidr, ip_to_int

            found = self._sides(side, lambda c: F.coalesce(in_cidr(ip_to_int(F.col(c)), str(net)), F.lit(False)), "sip", "dip")
        else:
            host = self.take() if word == "host" else word
            ipaddress.ip_address(host)
            found = self._sides(side, lambda c: F.coalesce(F.col(c) == host, F.lit(False)), "sip", "dip")
        return found if proto is None else proto & found

    @staticmethod
    def _sides(side, test, src: str, dst: str) -> Column:
        if side == "src":
            return test(src)
        return test(dst) if side == "dst" else test(src) | test(dst)


def compiled(text: str) -> Column:
    """The predicate of an expression; an empty one passes everything."""
    if not text.strip():
        return F.lit(True)
    parser = _Parser(text)
    found = parser.either()
    if parser.at != len(parser.tokens):
        raise ValueError(f"unexpected {parser.tokens[parser.at]!r}")
    return F.coalesce(found, F.lit(False))
