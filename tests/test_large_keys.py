"""Queries against their SQL twins where keys are as large as on large tables: numbers beyond an octet, a port or a DNS id."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from rillspan.operators import filters
from rillspan.plans import decoder_queries  # noqa: F401 - registers its queries
from rillspan.plans.queries import ORACLES, QUERIES
from tests.test_queries import SF, canonical

#: For each table its keys with the shift of every copy.
SHIFTS = {
    "events": [{"event_id": 0, "user_id": 70000}, {"event_id": 65536, "user_id": 70000}, {"event_id": 5000000, "user_id": 0}],
    "pages": [{"page_id": 7050}, {"page_id": 70000}],
    "customer": [{"c_custkey": 0}, {"c_custkey": 600000}],
    "part": [{"p_partkey": 0}, {"p_partkey": 70000}],
    "nation": [{}],
}
NAMES = (
    "reserved_of_both_kinds address_predicate bpf_filter connections_without_handshake decode_dhcp decode_dns decode_dns_all decode_dns_asn decode_dns_cc decode_flash decode_followstream"
    " decode_innuendo decode_ip decode_ms15_034 decode_netflow decode_reservedips dns_only_unanswered dns_only_unasked decode_web http_uploads packet_ordinals decode_track decode_synrst"
    " decode_psexec smb_pairing fan_out export_streams"
).split()


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    for name, copies in SHIFTS.items():
        each = [f"SELECT * REPLACE ({', '.join(f'{c} + {n} AS {c}' for c, n in keys.items())}) FROM '{SF}/{name}.parquet'" if keys else f"FROM '{SF}/{name}.parquet'" for keys in copies]
        con.execute(f"COPY ({' UNION ALL '.join(each)}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_large_keys(spark, large, name):
    folder, con = large
    got, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_reserved_reads_an_address_once(spark):
    """Every block repeated the whole parser of addresses, so time went with their number squared."""
    assert str(filters.is_reserved(F.col("address"))).count("split(") <= 8
    rows = [("fe80::1", True), ("64:ff9b::1:5817", True), ("2a00::1", False), ("8.8.8.8", False), ("10.1.2.3", True), ("::ffff:808:808", True), ("1::2::3", False), ("256.1.1.1", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "address string, want boolean")
    assert df.filter(filters.is_reserved(F.col("address")) != F.col("want")).count() == 0
