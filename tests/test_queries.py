"""A sample of the registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("supplier", "part", "lineitem", "documents", "nation")
NAMES = ("rank_backcross_progeny", "j3_classify", "w1_marker_weights_bp", "a9_duplicate_pairs", "f5_qc_flags", "t5_compared_markers", "a30_validation_summary", "w5_segments", "w8_monotone_anchors", "t4_map_warnings", "s1_vcf_calls", "s5_hapmap_calls",
         "s15_kasp_grid", "s11e_matrix_calls", "j9_interpolate_cm", "j7_position_table", "w3_staged_rank", "j2_assembly_findings", "k9_family_lines", "a27_map_steps")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())


@pytest.mark.skipif("BUILD_ALL" not in os.environ, reason="takes minutes: set BUILD_ALL=1")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_every_plan_is_built(spark, name):
    """Registered names and arguments fit the library: each query gives a plan with columns."""
    assert entry.queries()[name](spark, FOLDER).columns


def test_every_query_is_described():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own - set(entry.oracle_sql()) == set()
