"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from rillspan.plans import decoder_queries, function_queries
from rillspan.plans.queries import ORACLES, QUERIES

#: One query of each family of decoders; the driver compares all of them.
DECODERS = (
    "decode_dns_all decode_reservedips decode_web decode_ms15_034 decode_netflow decode_followstream decode_synrst defragmented decode_ftp decode_tftp decode_dhcp"
    " smb_pairing decode_smb_uploads decode_xor partial_content bpf_filter handler_hooks capture_to_container export_streams flow_line_fields"
).split()
NAMES = sorted(n for n in QUERIES if QUERIES[n].__module__ != decoder_queries.__name__ or n in DECODERS)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda n: names[n])
    show = lambda v: "" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[n]) for n in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES) and function_queries.query is decoder_queries.query


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
