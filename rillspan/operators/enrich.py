"""Country and network enrichment, and the predicates built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspan.functions.net import ip_to_int
from rillspan.operators.correlate import ranges_lookup

UNKNOWN = "--"


def with_geo(packets: DataFrame, ranges: DataFrame, small: bool = False) -> DataFrame:
    """Add ``sipcc, sipasn, dipcc, dipasn`` from ``lo, hi, cc, asn``; unknown is ``--``.

    ``small`` says that the ranges' size is known to fit a broadcast.
    """
    out = packets
    for side in ("sip", "dip"):
        ips = packets.select(side).distinct().withColumn("_n", ip_to_int(F.col(side))).filter("_n is not null")
        found = ranges_lookup(ips, ranges, "_n", small=small).groupBy(side).agg(F.max("cc").alias("cc"), F.max("asn").alias("asn"))
        out = out.join(found.select(side, F.col("cc").alias(f"{side}cc"), F.col("asn").alias(f"{side}asn")), side, "left")
        out = out.withColumns({f"{side}{k}": F.coalesce(f"{side}{k}", F.lit(UNKNOWN)) for k in ("cc", "asn")})
    return out


def dns_kept(rcode: Column, n_answers: Column, has_request: Column, has_response: Column, show_all: bool = False,
             show_noanswer: bool = False, only_noanswer: bool = False, show_norequest: bool = False, only_norequest: bool = False) -> Column:
    """Which request/response pairs to report.

    By default answered ones without error and names that do not exist; options
    add or isolate unanswered requests and unsolicited responses.
    """
    unanswered, unasked = has_request & ~has_response, ~has_request & has_response
    if only_noanswer:
        return unanswered
    if only_norequest:
        return unasked
    usual = has_request & has_response & (((rcode == "NOERROR") & (n_answers > 0)) | (rcode == "NXDOMAIN"))
    if show_all:
        return F.lit(True)
    if show_noanswer:
        usual = usual | unanswered
    if show_norequest:
        usual = usual | unasked
    return F.coalesce(usual, F.lit(False))


def foreign_answers(answers: Column, home: str = "US", code: str = "") -> Column:
    """Answers (with ``cc``) from abroad, or from one country."""
    if code:
        return F.filter(answers, lambda a: a["cc"] == code)
    return F.filter(answers, lambda a: ~a["cc"].isin(home, UNKNOWN))


def answer_line(answers: Column, tag: str = "cc") -> Column:
    """``A: ip (cc) (ttl 60s)`` of every answer."""
    return F.array_join(F.transform(answers, lambda a: F.format_string("%s: %s (%s) (ttl %ds)", a["type"], a["value"], a[tag], a["ttl"])), ", ")


def latest_names(messages: DataFrame, key: list[str], order: list[str], number: str, name: str) -> DataFrame:
    """Names of numbers (files, trees, users) as of each message of a session."""
    from rillspan.operators.correlate import as_of

    return as_of(messages, [*key, number], order, F.col(name), f"{name}_now")


def file_activity(messages: DataFrame, key: list[str], reads: Column, writes: Column, size: Column) -> DataFrame:
    """Reads, writes and bytes per file with its access mode."""
    from rillspan.functions.text import access_mode

    one = messages.groupBy(*key).agg(
        F.count_if(reads).alias("reads"), F.count_if(writes).alias("writes"),
        F.sum(F.when(reads, size).otherwise(0)).alias("bytes_read"), F.sum(F.when(writes, size).otherwise(0)).alias("bytes_written"),
    )
    return one.withColumn("mode", access_mode(F.col("reads"), F.col("writes")))
