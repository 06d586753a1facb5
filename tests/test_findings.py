"""Registered queries on tables that the smallest scale does not show."""

import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from introspark.operators import bitplanes, maps, similarity
from introspark.sources import grids, kasp, lines, pedigree, variant_pages, vcf
from workload import binding, texts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few_calls(tmp_path_factory):
    """The smallest tables with few of the lines: every sample misses more calls than the filters allow."""
    folder = str(tmp_path_factory.mktemp("few"))
    for name in ("part", "supplier"):
        duckdb.execute(f"COPY (FROM '{FOLDER}/{name}.parquet') TO '{folder}/{name}.parquet'")
    duckdb.execute(f"COPY (FROM '{FOLDER}/lineitem.parquet' WHERE l_orderkey % 500 = 0) TO '{folder}/lineitem.parquet'")
    return folder


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", ["a16_project_backcross", "a16_project_self"])
def test_no_projection_without_a_selection(spark, few_calls, name):
    assert [tuple(r) for r in entry.queries()[name](spark, few_calls).collect()] == by_sql(few_calls, name)[1] == []


def test_every_part_is_judged(spark):
    got = entry.queries()["f13_reserved_chromosome_names"](spark, FOLDER)
    columns, rows = by_sql(FOLDER, "f13_reserved_chromosome_names")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)
    assert len(rows) == duckdb.execute(f"SELECT count(*) FROM '{FOLDER}/part.parquet'").fetchall()[0][0]


def test_samples_below_the_floor_are_not_dealt(spark, monkeypatch):
    """Pairs need six common calls: of these samples only two have as many, and only they reach the blocks."""
    landed = {}
    plain = similarity.land
    monkeypatch.setattr(similarity, "land", lambda df, name: landed.setdefault(name, plain(df, name)))
    rows = [(f"m{i}", s, 0, i % 2) for s in ("x", "y") for i in range(30)] + [(f"m{i}", f"s{k}", 0, 0) for k in range(40) for i in range(k % 6)]
    calls = spark.createDataFrame(rows, "marker_id string, sample_id string, a1 int, a2 int")
    progeny = calls.select("sample_id").distinct().selectExpr("sample_id", "sample_id as sample_ord", "'F' as family_id")
    n = progeny.count()
    found = similarity.duplicate_scan(calls, calls.select("marker_id"), progeny, 30, n, min_overlap=0.2)
    assert [(r["sample_a"], r["sample_b"], r["n_overlap"]) for r in found.collect() if r["sample_a"]] == [("x", "y", 30)]
    assert similarity.skipped_pairs(found, n).first()["n_skipped"] == n * (n - 1) // 2 - 1
    assert sorted(r["sample_id"] for r in landed["sample-places"].collect()) == ["x", "y"]


def test_few_calls_are_packed_as_a_list():
    """A block of 1,000 samples with one call in 500: bytes grow with the calls, not with samples times markers."""
    rng = np.random.default_rng(1)
    cell = rng.choice(1000 * 4096, 8192, replace=False)
    row, at = (cell // 4096).astype(np.int32), (cell % 4096).astype(np.int32)
    table = pa.table({"row": row, "at": at, "n_at": np.full(len(cell), 4096, np.int32), "a1": row % 2, "a2": row % 3})
    packed = bitplanes.pack((pa.scalar(""), pa.scalar(0), pa.scalar(0)), table)
    assert sum(len(x) for x in packed.column("planes")[0].as_py()) <= 5 * len(cell)


@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_facts_of_many_files_reach_no_driver(spark, monkeypatch, limit):
    """Beyond the bound no facts are broadcast, not by Spark's own choice either; only files of many lines are spread."""
    monkeypatch.setattr(lines, "FILE_LINES", limit)
    text = spark.createDataFrame([(f"f{k}", i, f"{k},{i}") for k in range(30) for i in range(2 + k % 5)], "file string, ord long, value string")
    facts = lines.first_lines(text)
    large = lines.per_file(text, facts, most_bytes=0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    got = sorted((r["file"], r["ord"], r["head_ord"], r["header"]) for r in large.collect())
    assert got == sorted((f"f{k}", i, 0, [str(k), "0"]) for k in range(30) for i in range(2 + k % 5))


def test_wide_stretches_grow_with_the_calls(spark):
    """Few calls of many samples: a stretch holds its calls only, and the text of the lines still has every cell."""
    n = 1100
    rows = [(f"s{i:04d}", "m0", "f", i, "AA" if i in (3, 600) else None) for i in range(n)] + [(f"s{i:04d}", f"m{1 + i % 50}", "g", i, "AG") for i in range(0, n, 7)]
    calls = spark.createDataFrame(rows, "sample_id string, marker_id string, file string, ord long, call string")
    markers = spark.createDataFrame([(f"m{i}", "Gm01", i) for i in range(51)], "marker_id string, chrom string, pos_bp long")
    stretches, order, width = kasp.wide_stretches(calls)
    assert stretches.selectExpr("sum(size(cells))").first()[0] == sum(r[4] is not None for r in rows) and width == n
    want = {(m, s): call for s, m, _, _, call in rows if call is not None}
    found = kasp.wide_calls(stretches, order, markers, width).collect()
    assert {(r["marker_id"], r["sample_id"]): r["cell"] for r in found} == want and {r["n_cells"] for r in found} == {n}
    text = {r["marker_id"]: r["cells"].split(",") for r in kasp.wide_table(calls, markers)[0].collect()}
    assert text == {f"m{i}": [want.get((f"m{i}", f"s{k:04d}"), "N") for k in range(n)] for i in range(51)}


def test_short_stretches_are_solved_together(monkeypatch):
    """Stretches stream through a task: those of one frame are one step, and one that goes on waits for its end."""
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 4, n).astype(float) for n in (1, 3, 1, 12, 2, 5)]
    rows = pd.DataFrame([("c", 100 * k, 0.0, f"s{k}", f"m{k}-{i}", 100 * k + i, v) for k, piece in enumerate(pieces) for i, v in enumerate(piece)],
                        columns=[*maps._PIECE, "marker_id", "pos_bp", "cm"])
    wanted = [bool(x) for piece in pieces for x in maps._keep_earliest(piece)]
    asked = []
    plain = maps._keep_earliest
    monkeypatch.setattr(maps, "_keep_earliest", lambda values: asked.append(len(values)) or plain(values))
    for size in (1, 2, 5, 7, len(rows)):
        asked.clear()
        out = pd.concat(maps._solved(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)])))
        assert out["kept"].tolist() == wanted and out["marker_id"].tolist() == rows["marker_id"].tolist()
        assert asked == [len(p) for p in pieces if (np.diff(p) < 0).any()]
    assert len(list(maps._solved(iter([rows])))) == 2


def test_no_python_group_per_stretch(spark):
    anchors = spark.createDataFrame([(f"m{i}", "c", i * 1000, float(i)) for i in range(50)], "marker_id string, chrom string, pos_bp long, cm double")
    plan = maps.monotone_anchors(anchors)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_page_warnings_take_ids_from_the_pages(spark):
    """Ids of misshapen pages and of pages without a cell are not carried, and no cell is made to find them."""
    page = '{{"result": {{"variantDbIds": {}, "callSetDbIds": {}, "dataMatrices": [{{"dataMatrixAbbreviation": "GT", "dataMatrix": {}}}]}}}}'
    rows = [("a", page.format('["v1", " v2"]', '["c1"]', '[["0"], [null]]')), ("b", page.format('["v3"]', '["c2", "c3"]', '[["0"]]')), ("c", page.format('["v4"]', "[]", "[[]]"))]
    pages = variant_pages.page_from_json(spark.createDataFrame(rows, "file string, value string"), variant_pages.MATRIX_PAGE)
    carried = variant_pages.carried_ids(pages)
    assert sorted(map(tuple, carried.collect())) == [("call_set_db_id", "c1"), ("variant_db_id", "v1"), ("variant_db_id", "v2")]
    cells = variant_pages.matrix_cells(pages)
    assert {r[0] for r in cells.select("variant_db_id").collect()} == {"v1", "v2"}
    generators = re.findall(r"Generate inline", carried._jdf.queryExecution().optimizedPlan().toString())
    assert len(generators) == 1


def test_rows_are_parsed_once(spark):
    """Markers, calls and violations of a source read its written rows, not its lines."""
    wide = spark.createDataFrame([("f", 0, "marker_id,chrom,pos_bp,x,y"), ("f", 1, "m1,1,5,A,T"), ("f", 2, "m2,1,6,?!,A"), ("f", 3, "m3,1,z,A,A")], "file string, ord long, value string")
    record = spark.createDataFrame([("f", 0, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx"), ("f", 1, "1\t5\tm1\tA\tC\t.\t.\t.\tGT\t0/1"), ("f", 2, "1\t6\tm2\tA\tC\t.\t.\t.\tGT\t0/2")], "file string, ord long, value string")
    for found, kinds in ((grids.parse_wide(wide, "nucleotide"), ["invalid position", "unrecognised call"]), (vcf.parse_vcf(record), ["allele index beyond the record's alleles"])):
        assert sorted(r["kind"] for r in found.violations.collect()) == kinds
        for table in (found.markers, found.calls):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "Scan ExistingRDD" not in plan and "FileScan parquet" in plan


def test_batches_hold_the_calls_of_the_bound_tables(spark):
    rows = texts.batch_cells(spark, FOLDER).selectExpr("p", "n", "inline(array(c0, c1, c2, c3))").filter("s is not null")
    got = rows.selectExpr("concat('m', p)", "concat('s', s)", "a1", "a2")
    want = binding.progeny_calls(spark, FOLDER)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = texts.batch_cells(spark, FOLDER)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan  # the structs of a batch were sorted by batch and marker


def test_missing_alleles_are_no_numbers_to_be_tried(spark):
    head = "\t".join([*pedigree.VCF_COLUMNS, "a", "b"])
    rows = ["Gm01\t1\tx\tA\tC\t.\t.\t.\tGT\t./.\t0|1", "Gm01\t2\ty\tA\t.\t.\t.\t.\tGT\t.\t0/1:3", "Gm01\t3\tz\tA\tC,G\t.\t.\t.\tGT\t|\t2|+2", "x\t4\tu\tA\tC\t.\t.\t.\tGT\t9\t9"]
    text = spark.createDataFrame([("f", i, v) for i, v in enumerate(["##fileformat=VCFv4.2", head, *rows])], "file string, ord long, value string")
    families = spark.createDataFrame([("F", "a", 0, True), ("F", "b", 1, False)], "family string, sample_id string, place int, parent boolean")
    records, heads, violations = pedigree.extract_families(text, families)
    rejected = {r["pos"]: (r["gts"], r["reject"]) for r in records.collect()}
    assert rejected == {
        "1": (["./.", "0|1"], None), "2": ([".", "0/1"], "allele index exceeds ALT"), "3": (["|", "2|+2"], None), "4": (["9", "9"], "off canonical chromosomes"),
    }
    assert violations.count() == 0
    plan = pedigree.record_lines(records, heads)._jdf.queryExecution().optimizedPlan().toString()
    tried = re.findall(r"THEN try_cast\(lambda", plan)
    assert tried and len(tried) == plan.count("try_cast(")  # each behind a condition: a cast that fails throws inside


def test_a_call_of_a_page_is_split_once(spark):
    calls = entry.queries()["s11e_matrix_calls"](spark, FOLDER)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_known_calls_come_from_methods_that_are_compiled(spark, capsys):
    """A filter on the alleles repeated their expressions, in a method of more bytes than the JVM compiles."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        binding.progeny_calls(spark, FOLDER).filter("a1 is not null and a2 is not null").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_warnings_read_pages_once(spark):
    """A page is parsed in one place of the plan, and an id listed twice that no page carries is reported twice."""
    sets = '{"result": {"data": [{"callSetDbId": "c1", "callSetName": "a"}, {"callSetDbId": "c2", "callSetName": "b"}, {"callSetDbId": "c2", "callSetName": "b"}]}}'
    variants = '{"result": {"data": [{"variantDbId": "v1", "referenceName": "Gm01", "start": 1}, {"variantDbId": "v2", "referenceName": "Gm01", "start": 2}]}}'
    matrix = '{"result": {"variantDbIds": [" v1"], "callSetDbIds": ["c1"], "dataMatrices": [{"dataMatrixAbbreviation": "GT", "dataMatrix": [["0"]]}]}}'
    pages = [
        variant_pages.page_from_json(spark.createDataFrame([("f", text), ("g", "no page")], "file string, value string"), schema)
        for text, schema in ((sets, variant_pages.CALL_SET_PAGE), (variants, variant_pages.VARIANT_PAGE), (matrix, variant_pages.MATRIX_PAGE))
    ]
    warnings = variant_pages.parse_pages(*pages).warnings
    assert sorted(map(tuple, warnings.collect())) == [
        ("call set absent from every page", "c2"), ("call set absent from every page", "c2"), ("shared call set name", "b"), ("variant absent from every page", "v2")]
    assert warnings._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_pages_of_cells_are_dealt_once(spark):
    plan = texts.page_cells(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = texts.page_cells(spark, FOLDER).selectExpr("b", "names", "inline(rows)").selectExpr("names", "p", "posexplode(c) as (k, x)")
    got = rows.filter("x is not null").selectExpr("concat('m', p)", "names[k]", "x.a1", "x.a2")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, binding.progeny_calls(spark, FOLDER).collect()), key=str)


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_lines_of_a_grid_are_dealt_once(spark, monkeypatch, most):
    """Which way a file faces, and its cells, come from lines that were dealt by file once; files may have whole numbers for names."""
    monkeypatch.setattr(lines, "PER_FILE_BYTES", 0)
    monkeypatch.setattr(lines, "FILE_LINES", most)
    text = spark.createDataFrame([(f, i, v) for f, rows in (("x", ["d,m1,m2", "s1,A:A,C:C"]), ("y", ["d,s1,s2", "m1,A:C,?"]), ("z", ["d,m1", "m2,A:A"]), ("w", ["d,q", "r,A:A"]), ("v", ["d,m1"])) for i, v in enumerate(rows)],
                                 "file string, ord long, value string")
    markers = spark.createDataFrame([("m1",), ("m2",)], "marker_id string")
    calls, bad = kasp.parse_grid(text, markers)
    assert sorted(map(tuple, calls.select("file", "sample_id", "marker_id", "call").collect()), key=str) == [
        ("x", "s1", "m1", "AA"), ("x", "s1", "m2", "CC"), ("y", "s1", "m1", "AC"), ("y", "s2", "m1", None), ("z", "m2", "m1", "AA")]
    assert [(r["file"], r["kind"]) for r in bad.collect()] == [("w", "no axis of the grid matches the markers")]
    calls.collect()
    assert re.search(r"ReusedExchange \[file#\d+, ord#\d+L, value#\d+, _salt#\d+\]", calls._jdf.queryExecution().executedPlan().toString())
    whole = lines.per_file(spark.createDataFrame([(1, 0)], "file long, ord long"), spark.createDataFrame([(1, 5)], "file long, n int"))
    assert [tuple(r) for r in whole.collect()] == [(1, 0, 5)]
