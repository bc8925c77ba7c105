"""Addresses, protocol names and anonymisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocol numbers assigned by IANA.
PROTOCOLS = {1: "ICMP", 4: "IP", 6: "TCP", 17: "UDP", 41: "IP6", 58: "ICMP6"}


def ip_to_int(ip: Column) -> Column:
    """IPv4 text as an integer; null for anything else."""
    octets = F.split(ip, "\\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda x: x.try_cast("int") <= 255), value)


def int_to_ip(value: Column) -> Column:
    parts = [F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def protocol_name(number: Column) -> Column:
    """Name of an IP protocol, else its number."""
    known: Column | None = None
    for n, name in PROTOCOLS.items():
        known = F.when(number == n, F.lit(name)) if known is None else known.when(number == n, F.lit(name))
    return known.otherwise(number.cast("string"))


def in_cidr(ip: Column, cidr: str) -> Column:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return ip.between(int(net.network_address), int(net.broadcast_address))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named; aliases and filters would repeat it."""
    return F.transform(F.array(value), use)[0]


def ip_key(ip: Column) -> Column:
    """An address of either kind as 32 hexadecimal digits in numeric order, IPv4 as mapped; null for anything else."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def filled(sides: Column, parts: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(sides["left"]) - F.size(sides["right"]), F.lit(0)))
        return F.concat(sides["left"], F.when(F.size(parts) > 1, zeros).otherwise(F.expr("cast(array() as array<string>)")), sides["right"])

    def sides_of(parts: Column) -> Column:
        right = groups(F.when(F.size(parts) > 1, parts[1]).otherwise(F.lit("")))
        return held(F.struct(groups(parts[0]).alias("left"), right.alias("right")), lambda sides: filled(sides, parts))

    def six(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    v4 = held(ip_to_int(ip), lambda n: F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(n), 8, "0"))))
    return F.when(F.contains(ip, F.lit(":")), held(held(F.split(F.lower(ip), "::"), sides_of), six)).otherwise(v4)


def key_bounds(cidr: str) -> tuple[str, str]:
    """First and last ``ip_key`` of a block."""
    import ipaddress

    net = ipaddress.ip_network(cidr)
    shift = 0xFFFF << 32 if net.version == 4 else 0
    return f"{int(net.network_address) + shift:032x}", f"{int(net.broadcast_address) + shift:032x}"


def located(rows: DataFrame, ranges: DataFrame, address: str, digits: int = 28) -> DataFrame:
    """Rows with the columns of the range whose ``lo_key..hi_key`` holds their address, of either kind.

    Joined by the first ``digits`` of the key where a range lies within one such
    prefix, else by the longest prefix its ends share, one join for each length
    that occurs among the ranges; their number is bounded by the key's length.
    """
    same = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0), lambda a, k: F.when((a == k - 1) & (F.substring("lo_key", 1, k) == F.substring("hi_key", 1, k)), k).otherwise(a))
    keyed = ranges.withColumn("_len", F.least(same, F.lit(digits))).withColumn("_prefix", F.substring("lo_key", 1, F.col("_len")))
    lengths = F.array(*map(F.lit, sorted(r[0] for r in keyed.select("_len").distinct().collect())))
    ips = rows.select(address).distinct().withColumn("_key", ip_key(F.col(address)))
    asked = ips.select(address, "_key", F.explode(F.transform(lengths, lambda n: F.substring("_key", F.lit(1), n))).alias("_prefix"))
    hit = asked.join(keyed, "_prefix").filter(F.col("_key").between(F.col("lo_key"), F.col("hi_key")))
    extra = [c for c in ranges.columns if c not in ("lo_key", "hi_key")]
    best = hit.groupBy(address).agg(F.max_by(F.struct(*extra), "_len").alias("_found"))
    return rows.join(best, address, "left").select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in extra))


def low_port_swap(df: DataFrame, a: str = "src", ap: str = "sport", b: str = "dst", bp: str = "dport") -> DataFrame:
    """Turn rows round so that the destination has the lower port."""
    swap = F.col(ap) < F.col(bp)
    return df.withColumns({
        a: F.when(swap, F.col(b)).otherwise(F.col(a)), ap: F.when(swap, F.col(bp)).otherwise(F.col(ap)),
        b: F.when(swap, F.col(a)).otherwise(F.col(b)), bp: F.when(swap, F.col(ap)).otherwise(F.col(bp)),
    })


def anonymous_names(values: DataFrame, column: str, key: str, digits: int = 12) -> DataFrame:
    """``column, alias``: one stable pseudonym for each distinct value."""
    alias = F.substring(F.sha1(F.concat(F.lit(key), F.col(column))), 1, digits)
    return values.select(column).distinct().withColumn("alias", alias)


def anonymous_ip(ip: Column, key: str, network: str = "10.0.0.0/8") -> Column:
    """An IPv4 integer mapped into a network by a keyed hash.

    Multicast, private and loopback addresses pass unchanged.
    """
    import ipaddress

    net = ipaddress.ip_network(network)
    digest = F.conv(F.substring(F.sha1(F.concat(F.lit(key), ip.cast("string"))), 1, 8), 16, 10).cast("long")
    mapped = F.lit(int(net.network_address)) + digest % net.num_addresses
    keep = in_cidr(ip, "10.0.0.0/8") | in_cidr(ip, "172.16.0.0/12") | in_cidr(ip, "192.168.0.0/16") | in_cidr(ip, "127.0.0.0/8") | in_cidr(ip, "224.0.0.0/4")
    return F.when(keep, ip).otherwise(mapped)


def anonymous_flow_ports(a: Column, ap: Column, b: Column, bp: Column, key: str) -> Column:
    """A keyed hash of a flow that is the same in both directions."""
    one, two = F.concat_ws(":", a, ap), F.concat_ws(":", b, bp)
    return F.sha1(F.concat_ws("|", F.lit(key), F.least(one, two), F.greatest(one, two)))


def anonymous_mac(mac: Column, key: str) -> Column:
    """A keyed hash of a MAC address with the locally-administered bit set; multicast passes."""
    hexed = F.sha1(F.concat(F.lit(key), F.lower(mac)))
    first = F.conv(F.substring(hexed, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(0xFC)).bitwiseOR(F.lit(0x02))
    tail = F.regexp_replace(F.substring(hexed, 3, 10), "(..)", ":$1")
    multicast = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    return F.when(multicast, mac).otherwise(F.concat(F.lower(F.lpad(F.hex(first), 2, "0")), tail))


def rebased(ts: Column, start: Column, first: Column) -> Column:
    """A timestamp moved so that ``first`` falls on ``start`` (all in seconds)."""
    return start + (ts - first)
