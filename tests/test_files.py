"""Files on disk: what the sinks write, the readers read back, in order and under one header line."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from introspark.config import criteria_from_dict
from introspark.operators import select
from introspark.operators.dataset import Dataset
from introspark.plans import rank
from introspark.sinks import export
from introspark.sources import grids, kasp, manifest, pedigree, results, variant_pages, vcf
from introspark.sources.lines import read_lines


def lines_of(folder):
    return [line for part in sorted(Path(folder).glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture(scope="module")
def run(spark):
    markers = spark.createDataFrame([(f"m{i}", "Gm01", (i + 1) * 1000, None, i) for i in range(12)], "marker_id string, chrom string, pos_bp long, cm double, file_ord long")
    people = [("rp", "rp", "recurrent_parent", None, None, None), ("dp", "dp", "donor_parent", None, None, 'a "b", c')]
    people += [(f"s{k}", f"line {k}", "progeny", "BC1F1", f"F{k % 2}", "x, y" if k == 3 else None) for k in range(9)]
    samples = spark.createDataFrame(people, "sample_id string, line_name string, role string, generation string, family_id string, notes string")
    calls = [(f"m{i}", s, a, a) for i in range(12) for s, a in (("rp", 0), ("dp", 1))] + [(f"m{i}", f"s{k}", 0, int(i < 5 or (i * k) % 5 == 1)) for i in range(12) for k in range(9)]
    data = Dataset(markers, samples, spark.createDataFrame(calls, "marker_id string, sample_id string, a1 int, a2 int"))
    criteria = {"targets": [{"id": "T", "region": "Gm01:1000-5000"}], "flank_unit": "bp", "background": {"map_unit": "bp"}, "filters": {"unknown_target_is": "pass"}}
    return rank.analyse(data, criteria_from_dict(criteria))


def test_results_round_trip(spark, run, tmp_path):
    table = rank.results(run)
    export.write_results(table, f"{tmp_path}/results")
    lines = lines_of(tmp_path / "results")
    assert lines[0].split(",") == table.columns and len(lines) == 10 and sum(line == lines[0] for line in lines) == 1
    back = results.read_results(spark, f"{tmp_path}/results")
    want = results.parse_results(export.results_text(table)).select(*back.columns)
    assert back.columns == table.columns and sorted(map(repr, back.collect())) == sorted(map(repr, want.collect()))
    ranks = [None if r == "NA" else float(r) for r in (line.split(",")[table.columns.index("rank_overall")] for line in lines[1:])]
    assert ranks == sorted(ranks, key=lambda r: (r is None, r or 0)) and ranks[0] == 1
    assert results.contract_problems(back.columns) == []
    with pytest.raises(FileExistsError):
        export.write_results(table, f"{tmp_path}/results")
    broken = table.withColumn("rank_overall", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        export.write_results(broken, f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()


def test_selection_and_manifest_round_trip(spark, run, tmp_path):
    ranked = rank.results(run)
    chosen = select.top_n(ranked, 2)
    export.write_selection(chosen, f"{tmp_path}/selection", run.dataset.samples)
    back = results.read_table(spark, f"{tmp_path}/selection")
    rows = back.collect()
    assert [(r["family_id"], int(r["rank_in_family"])) for r in rows] == sorted((r["family_id"], int(r["rank_in_family"])) for r in rows) and len(rows) == chosen.count()
    assert {r["sample_id"]: r["notes"] for r in rows} == {r["sample_id"]: "x, y" if r["sample_id"] == "s3" else "" for r in rows}
    export.write_manifest(select.next_manifest(chosen.withColumn("line_name", F.lit("l")), run.dataset.samples, "BC2F1", 2), f"{tmp_path}/samples")
    samples, violations = manifest.read_samples(spark, f"{tmp_path}/samples", parts=True)
    assert [tuple(r) for r in violations.collect()] == [] and samples.count() == 2 + 2 * len(rows)
    assert samples.filter("role = 'donor_parent'").first()["notes"] == 'a "b", c'
    assert [line.split(",")[2] for line in lines_of(tmp_path / "samples")[:3]] == ["role", "recurrent_parent", "donor_parent"]
    (tmp_path / "samples.csv").write_text("sample_id,role\na,recurrent_parent\nb,donor_parent\nc,progeny\n")
    assert manifest.read_samples(spark, f"{tmp_path}/samples.csv")[0].count() == 3


def test_map_call_sets_and_wide_lines_round_trip(spark, tmp_path):
    markers = spark.createDataFrame([("m9", "Gm10", 7, None), ("m1", "Gm02", 9, 0.1234567), ("m2", "Gm02", 3, 2.0)], "marker_id string, chrom string, pos_bp long, cm double")
    export.write_map(markers, f"{tmp_path}/map")
    assert lines_of(tmp_path / "map") == ["marker_id,chrom,pos_bp,cm", "m2,Gm02,3,2.0", "m1,Gm02,9,0.123457", "m9,Gm10,7,"]
    back, violations = manifest.read_marker_map(spark, f"{tmp_path}/map", parts=True)
    assert violations.count() == 0 and {(r["marker_id"], r["pos_bp"], r["cm"]) for r in back.collect()} == {("m2", 3, 2.0), ("m1", 9, 0.123457), ("m9", 7, None)}
    sets = spark.createDataFrame([("b", 'n,"1"', "c2", ""), ("a", "n", "c1", "d")], "sample_id string, call_set_name string, call_set_db_id string, sample_db_id string")
    export.write_call_sets(sets, f"{tmp_path}/sets")
    assert sorted(map(tuple, results.read_table(spark, f"{tmp_path}/sets").collect())) == sorted(map(tuple, sets.collect()))
    rows = [(f"s{k:03d}", m, "f", k, "AC" if k % 2 else "AA") for k in range(700) for m in ("m1", "m2")]
    wide = kasp.wide_table(spark.createDataFrame(rows, "sample_id string, marker_id string, file string, ord long, call string"), markers.select("marker_id", "chrom", "pos_bp"))
    export.write_wide(*wide, f"{tmp_path}/wide")
    assert [line.split(",")[:4] for line in lines_of(tmp_path / "wide")] == [["marker_id", "chrom", "pos_bp", "s000"], ["m2", "Gm02", "3", "AA"], ["m1", "Gm02", "9", "AA"]]
    read = grids.parse_wide(read_lines(spark, f"{tmp_path}/wide", parts=True), coding="nucleotide")
    assert read.violations.count() == 0 and read.calls.filter("a1 = 0 and a2 = 1").count() == 700


def test_vcf_and_hapmap_files(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    (tmp_path / "a.vcf").write_text(f"##fileformat=VCFv4.2\r\n{head}\tr\tl\r\nGm01\t5\tm\tA\tC\t.\t.\t.\tGT\t0/0\t0|1\r\n")
    found = vcf.read_vcf(spark, f"{tmp_path}/a.vcf").require_clean()
    assert {tuple(r) for r in found.calls.collect()} == {("m", "r", 0, 0), ("m", "l", 0, 1)}
    families = spark.createDataFrame([("F", "r", 0, True), ("F", "l", 1, False)], "family string, sample_id string, place int, parent boolean")
    records, heads, _ = pedigree.extract_families(read_lines(spark, f"{tmp_path}/a.vcf"), families)
    own = pedigree.record_lines(records, heads).orderBy("ord")
    export.write_lines(own.limit(0), own, f"{tmp_path}/family")
    again = vcf.read_vcf(spark, f"{tmp_path}/family", parts=True).require_clean()
    assert sorted(map(tuple, again.calls.collect())) == sorted(map(tuple, found.calls.collect()))
    names = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\tx\ty"
    (tmp_path / "a.hmp.txt").write_text(f"{names}\nm1\tA/C\t1\t5\t+\tNA\tNA\tNA\tNA\tNA\tNA\tAA\tAC\n")
    assert grids.read_hapmap(spark, f"{tmp_path}/a.hmp.txt").require_clean().calls.count() == 2


def test_pages_of_a_folder_in_page_order(spark, tmp_path):
    def page(name, result):
        (tmp_path / f"{name}.json").write_text(json.dumps({"result": result}))

    for k in (1, 2, 10):
        page(f"variants{k}", {"data": [{"variantDbId": f"v{k}{x}", "variantNames": [f"m{k}{x}"], "referenceName": "Gm01", "start": k, "referenceBases": "A", "alternateBases": ["C"]} for x in "ba"]})
        page(f"allelematrix{k}", {"callSetDbIds": ["c1", "c2"], "variantDbIds": [f"v{k}b", f"v{k}a"], "dataMatrices": [{"dataMatrixAbbreviation": "GT", "dataMatrix": [["0/1", "0|0"], ["1", "."]]}]})
    page("callsets1", {"data": [{"callSetDbId": f"c{i}", "callSetName": f"s{i}", "sampleDbId": f"d{i}"} for i in (1, 2)]})
    found = variant_pages.read_pages(spark, str(tmp_path))
    assert found.violations.count() == 0 and found.calls.count() == 12
    assert [r["marker_id"] for r in found.markers.orderBy("file_ord").collect()] == ["m1b", "m1a", "m2b", "m2a", "m10b", "m10a"]
