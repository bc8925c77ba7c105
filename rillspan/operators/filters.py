"""Filters: country and network names, content rules, regular-expression grep, ports."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspan.functions.patterns import quote


def country_label(client: Column, server: Column, code: str, neither: bool = False, both: bool = False, not_both: bool = False) -> Column:
    """Why a flow matches a country, null where it does not.

    Modes take precedence in this order: neither, both, not both; without a
    mode the client counts before the server.  An empty code passes all.
    """
    if code == "":
        return F.lit("any")
    c, s = client.eqNullSafe(code), server.eqNullSafe(code)
    if neither:
        return F.when(~c & ~s, F.lit("neither"))
    if both:
        return F.when(c & s, F.lit("both"))
    if not_both:
        return F.when(c != s, F.lit("notboth"))
    return F.when(c, F.lit("client")).when(s, F.lit("server"))


def asn_match(client: Column, server: Column, text: str) -> Column:
    """Which side's network name contains the text, whatever the case; null for none."""
    want = text.lower()
    return F.when(F.contains(F.lower(client), F.lit(want)), F.lit("client")).when(F.contains(F.lower(server), F.lit(want)), F.lit("server"))


def either_port(a: Column, b: Column, *ports: int) -> Column:
    return a.isin(*ports) | b.isin(*ports)


@dataclass
class Content:
    """One content test of a rule: the text and where it may lie."""

    text: str
    nocase: bool = False
    offset: int = 0
    depth: int | None = None
    distance: int | None = None
    within: int | None = None


@dataclass
class Rule:
    """``alert proto src sport -> dst dport (options)``."""

    proto: str = "ip"
    src: str = "any"
    sport: str = "any"
    dst: str = "any"
    dport: str = "any"
    message: str = ""
    contents: list[Content] = field(default_factory=list)


_HEAD = re.compile(r"\s*alert\s+(\S+)\s+(\S+)\s+(\S+)\s+->\s+(\S+)\s+(\S+)\s*(?:\((.*)\))?\s*$", re.S)
_OPTION = re.compile(r"\s*([a-z_]+)\s*(?::\s*(\"(?:[^\"\\]|\\.)*\"|[^;]*))?;")


def _content(text: str) -> str:
    """A content text with ``|..|`` hexadecimal parts."""
    parts = text.split("|")
    return "".join(p if n % 2 == 0 else bytes.fromhex(p.replace(" ", "")).decode("latin-1") for n, p in enumerate(parts))


def parse_rule(line: str) -> Rule:
    """A rule from its text; what cannot be read raises ValueError."""
    m = _HEAD.match(line)
    if m is None:
        raise ValueError(f"not a rule: {line!r}")
    rule = Rule(m[1].lower(), m[2], m[3], m[4], m[5])
    for option in _OPTION.finditer(m[6] or ""):
        name, value = option[1], (option[2] or "").strip()
        if value.startswith('"'):
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        if name == "msg":
            rule.message = value
        elif name == "content":
            rule.contents.append(Content(_content(value)))
        elif name == "nocase":
            rule.contents[-1].nocase = True
        elif name in ("offset", "depth", "distance", "within"):
            setattr(rule.contents[-1], name, int(value))
        else:
            raise ValueError(f"unknown option {name!r}")
    return rule


def parse_rules(text: str) -> list[Rule]:
    """Rules of a file, one a line; blank lines and comments are passed over."""
    return [parse_rule(x) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def _chains(contents: list[Content]) -> list[list[Content]]:
    """Each content that is not relative, with the relative ones after it."""
    found: list[list[Content]] = []
    for c in contents:
        if not found or (c.distance is None and c.within is None):
            found.append([])
        found[-1].append(c)
    return found


def _chain_pattern(chain: list[Content]) -> str | None:
    """A Java regular expression that tries every occurrence; null where no text can match."""
    parts = ["(?s)\\A"]
    for c in chain:
        relative = c.distance is not None or c.within is not None
        lo, room = (c.distance or 0, c.within) if relative else (c.offset, c.depth)
        hi = "" if room is None else lo + room - len(c.text)
        if hi != "" and hi < lo:
            return None
        parts.append(f".{{{lo},{hi}}}?" + (f"(?iu:{quote(c.text)})" if c.nocase else quote(c.text)))
    return "".join(parts)


def contents_match(text: Column, contents: list[Content]) -> Column:
    """Whether all contents occur, each after some match of the one before where it is relative.

    A relative content is tried after every occurrence of those before it; only
    after a negative distance does the first occurrence alone count.
    """
    ok: Column = F.lit(True)
    for chain in _chains(contents):
        if len(chain) == 1 or any((c.distance or 0) < 0 for c in chain):
            ok = ok & first_contents_match(text, chain)
        else:
            pattern = _chain_pattern(chain)
            ok = ok & (F.lit(False) if pattern is None else text.rlike(pattern))
    return ok


def first_contents_match(text: Column, contents: list[Content]) -> Column:
    """``contents_match`` with each relative content tried only after the first match before it."""
    end: Column = F.lit(0)
    ok: Column = F.lit(True)
    for c in contents:
        hay = F.lower(text) if c.nocase else text
        needle = c.text.lower() if c.nocase else c.text
        relative = c.distance is not None or c.within is not None
        start = end + (c.distance or 0) if relative else F.lit(c.offset)
        at = F.call_function("locate", F.lit(needle), hay, (F.greatest(start, F.lit(0)) + 1).cast("int"))
        good = at > 0
        if c.depth is not None and not relative:
            good = good & (at - 1 + len(needle) <= c.offset + c.depth)
        if c.within is not None:
            good = good & (at - 1 + len(needle) <= end + (c.distance or 0) + c.within)
        ok = ok & good
        end = at - 1 + len(needle)
    return ok


def _endpoint(address: Column, port: Column, want: str, want_port: str) -> Column:
    cond: Column = F.lit(True)
    if want != "any":
        negate, value = want.startswith("!"), want.lstrip("!")
        hit = address == value
        cond = cond & (~hit if negate else hit)
    if want_port != "any":
        negate, value = want_port.startswith("!"), want_port.lstrip("!")
        if ":" in value:
            lo, hi = value.split(":")
            hit = (port >= int(lo or 0)) & (port <= int(hi or 65535))
        else:
            hit = port == int(value)
        cond = cond & (~hit if negate else hit)
    return cond


def rule_predicate(rule: Rule, data: str = "data", proto: str = "proto", src: str = "sip", sport: str = "sport", dst: str = "dip", dport: str = "dport", first_only: bool = False) -> Column:
    """A rule as a column predicate; nothing is evaluated as code."""
    cond = (first_contents_match if first_only else contents_match)(F.col(data), rule.contents)
    if rule.proto != "ip":
        cond = cond & (F.lower(proto) == rule.proto)
    if (rule.src, rule.sport) != ("any", "any"):
        cond = cond & _endpoint(F.col(src), F.col(sport), rule.src, rule.sport)
    if (rule.dst, rule.dport) != ("any", "any"):
        cond = cond & _endpoint(F.col(dst), F.col(dport), rule.dst, rule.dport)
    return cond


def apply_rules(df: DataFrame, predicates: list[Column], mode: str = "any") -> DataFrame:
    """Rows on which any, all or none of the predicates hold."""
    if mode not in ("any", "all", "none"):
        raise ValueError("mode must be any, all or none")
    joined: Column = F.lit(mode == "all")
    for p in predicates:
        p = F.coalesce(p, F.lit(False))
        joined = joined & p if mode == "all" else joined | p
    return df.filter(~joined if mode == "none" else joined)


def first_rule(df: DataFrame, predicates: list[Column], names: list[str]) -> DataFrame:
    """Add ``rule``: the name of the first predicate that holds."""
    label = F.coalesce(*(F.when(p, F.lit(n)) for p, n in zip(predicates, names, strict=True)))
    return df.withColumn("rule", label).filter(F.col("rule").isNotNull())


def grep_lines(df: DataFrame, text: str, regex: str, ignore_case: bool = False, groups: int = 0) -> DataFrame:
    """Lines (right-trimmed) that match, with ``line_no`` from 0 and groups ``m1 .. mn``."""
    pattern = ("(?i)" if ignore_case else "") + regex
    lines = df.select(*(c for c in df.columns if c != text), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.rtrim("line")).filter(F.col("line").rlike(pattern))
    return lines.withColumns({f"m{n}": F.regexp_extract("line", pattern, n) for n in range(1, groups + 1)})


def grep_iterate(df: DataFrame, text: str, regex: str, group: int = 1) -> DataFrame:
    """Every match in the whole text, a dot matching line ends too: ``match_no`` from 0 and ``m1``."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s){regex}"), group)).alias("match_no", "m1")
    return df.select(*(c for c in df.columns if c != text), found)


def grep_chain(rows: DataFrame, matched: DataFrame, key: list[str], invert: bool = False) -> DataFrame:
    """Rows of the connections that matched, or with ``invert`` of all others."""
    return rows.join(matched, key, "left_anti" if invert else "left_semi")


# Address blocks that are reserved or private (IANA special-purpose registry).
RESERVED = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.2.0/24"
    " 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 255.255.255.255/32"
).split()
RESERVED_6 = (
    "::/128 ::1/128 ::ffff:0:0/96 100::/64 64:ff9b::/96 2001::/32 2001:10::/28 2001:db8::/32 2002::/16 fc00::/7 fe80::/10 ff00::/8"
).split()


def cidr_bounds(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def in_reserved(ip: Column, blocks: list[str] = RESERVED) -> Column:
    """Whether an IPv4 integer lies in any of these blocks."""
    cond: Column = F.lit(False)
    for lo, hi in map(cidr_bounds, blocks):
        cond = cond | ip.between(lo, hi)
    return cond


def is_reserved(address: Column) -> Column:
    """Whether an address as text, of either kind, lies in a reserved block; IPv4 is judged by its own blocks."""
    from rillspan.functions.net import held, ip_key, key_bounds

    def inside(key: Column, blocks: list[str]) -> Column:
        cond: Column = F.lit(False)
        for lo, hi in map(key_bounds, blocks):
            cond = cond | key.between(lo, hi)
        return cond

    judged = lambda a: held(ip_key(a), lambda key: F.when(F.contains(a, F.lit(":")), inside(key, RESERVED_6)).otherwise(inside(key, RESERVED)))
    found = held(address, judged)
    return F.coalesce(found, F.lit(False))
