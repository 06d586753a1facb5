"""Text inputs: accepted spellings, and the violations of broken ones."""

import re

import pytest
from pyspark.sql import functions as F

from introspark.functions.calls import genotype_field, linked_call, nucleotide_call, profile, token
from introspark.functions.chrom import CROPS, canonical_chrom, chrom_order
from introspark.functions.generation import parse_generation
from introspark.functions.text import position
from introspark.sinks.export import number_text, wide_lines
from introspark.sources import grids, kasp, linkage, lines, manifest, pedigree, vcf


def as_lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file string, ord bigint, value string")


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_positions(spark):
    got = column(spark, ["1000", "+1000", "1000.0", "1e3", "1.9E+07", "100.7", "1e-3", "-5", "", "nan", "0x10", "1_000", "-0", " 7 "], position)
    assert got == [1000, 1000, 1000, 1000, 19000000, None, None, None, None, None, None, None, 0, 7]
    assert column(spark, ["10", "+10", "1e1"], lambda c: position(c, True)) == [10, None, None]


def test_chromosome_spellings(spark):
    assert column(spark, ["1", "Gm01", "chr_01", "LG 20", "glyma.Wm82.gnm4.Gm05", "21", " scaffold_3 "], canonical_chrom) == [
        "Gm01", "Gm01", "Gm01", "Gm20", "Gm05", "21", "scaffold_3"]
    assert column(spark, ["chr1A", "7-d", "8A"], lambda c: canonical_chrom(c, CROPS["wheat"])) == ["Chr1A", "Chr7D", "8A"]
    assert column(spark, ["Chr_A01", "d13"], lambda c: canonical_chrom(c, CROPS["cotton"])) == ["A01", "D13"]
    assert column(spark, ["2(old7)", "vu2"], lambda c: canonical_chrom(c, CROPS["cowpea"])) == ["Vu02", "Vu02"]
    assert column(spark, ["chr1", "1LG6", "1"], lambda c: canonical_chrom(c, CROPS["pea"])) == ["chr1LG6", "chr1LG6", "1"]
    names = spark.createDataFrame([("scaffold_10",), ("Gm02",), ("scaffold_2",), ("Gm01",), ("a",)], "x string")
    assert [r[0] for r in names.orderBy(chrom_order(F.col("x"))).collect()] == ["Gm01", "Gm02", "a", "scaffold_2", "scaffold_10"]


def test_generation_labels(spark):
    labels = ["BC2F1", "bc2 f2", "BC2", "F2", "BC1S1", "S1", "F0", "RP*3/D", "2*RP/D", "D/RP*1", "A/B", "RP*0/D", "", None]
    got = [None if g is None else tuple(g) for g in column(spark, labels, parse_generation)]
    assert got == [(2, 1, True), (2, 2, True), (2, 1, True), (0, 2, True), (1, 2, True), (0, 2, True), None, (2, 1, False), (1, 1, False),
                   (0, 1, False), None, None, None, None]


def test_nucleotide_cells(spark):
    cells = ["a", "AT", "T/A", "C|C", "R", "NN", "A/N", "-.", "?", "A?", "A:T", "ATG", "X"]
    assert [tuple(r) for r in column(spark, cells, lambda c: nucleotide_call(token(c)))] == [
        ("call", "A", "A"), ("call", "A", "T"), ("call", "A", "T"), ("call", "C", "C"), ("call", "A", "G"), ("missing", None, None),
        ("missing", None, None), ("missing", None, None), ("bad", None, None), ("bad", None, None), ("bad", None, None), ("bad", None, None), ("bad", None, None)]
    axiom = [tuple(r) for r in column(spark, ["ab", "2", "nocall", "AT"], lambda c: nucleotide_call(token(c), False, profile("axiom")))]
    assert axiom == [("call", "A", "B"), ("call", "B", "B"), ("missing", None, None), ("bad", None, None)]


def test_genotype_fields(spark):
    got = [tuple(r) for r in column(spark, ["0/1", "1|.", "1", "", ".", "01/0", "3/0", "128"], lambda c: genotype_field(c, F.lit(3)))]
    assert [g[:2] for g in got[:5]] == [(0, 1), (1, None), (1, 1), (None, None), (None, None)]
    assert [g[2] is not None for g in got] == [False] * 5 + [True] * 3
    page = [tuple(r) for r in column(spark, ["0|1", "2", "N", "1/N", "127", "a"], lambda c: linked_call(c, F.lit("|"), F.lit("/"), F.lit("N")))]
    assert page == [(0, 1, None), (2, 2, None), (None, None, None), (None, None, None), (None, None, "invalid GT"), (None, None, "invalid GT")]


HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty"


def test_vcf_records_and_violations(spark):
    good = vcf.parse_vcf(as_lines(spark, "##v", HEAD, "", "1\t10\t.\tA\tC,G\t.\t.\t.\tDP:GT\t3:0/2\t5", "2\t20\tm\tA\t.\t.\t.\t.\tGT\t0|0\t.")).require_clean()
    assert sorted(map(tuple, good.calls.collect()), key=str) == sorted(
        [("1_10", "x", 0, 2), ("1_10", "y", None, None), ("m", "x", 0, 0), ("m", "y", None, None)], key=str)
    assert [r["alleles"] for r in good.markers.orderBy("pos_bp").collect()] == [["A", "C", "G"], ["A"]]
    bad = vcf.parse_vcf(as_lines(spark, "1\t5\ta\tA\tC\t.\t.\t.\tGT\t0\t0", HEAD, HEAD, "1\t5", "1\t1e3\tb\tA\tC\t.\t.\t.\tGT\t0\t0",
                                 "1\t7\tc\tA\tC\t.\t.\t.\tDP\t0\t0", "1\t8\td\tA\tC\t.\t.\t.\tGT\t0/2\t0"))
    kinds = [r["kind"] for r in bad.violations.orderBy("ord").collect()]
    assert kinds == ["data line before the #CHROM header", "line beginning with # after the header", "wrong number of columns", "invalid position",
                     "FORMAT has no GT", "allele index beyond the record's alleles"]
    with pytest.raises(lines.SourceError, match="before the #CHROM header"):
        bad.require_clean()


def test_files_and_quoted_cells(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('marker_id,chrom,pos_bp,s1,"s,2"\n\n"m""1",1,1e6,A,A/G\nm2,2,5,N,G\n')
    parsed = grids.read_wide(spark, str(path)).require_clean()
    assert sorted(map(tuple, parsed.calls.collect()), key=str) == sorted(
        [('m"1', "s1", 0, 0), ('m"1', "s,2", 0, 1), ("m2", "s1", None, None), ("m2", "s,2", 0, 0)], key=str)
    assert not parsed.coded
    (tmp_path / "coded.csv").write_text("marker_id\tchrom\tpos_bp\ts1\nm\t1\t1\tH\n")
    assert grids.read_wide(spark, str(tmp_path / "coded.csv")).coded


def test_manifest_rules(spark):
    rows = as_lines(spark, "role,Sample_ID,notes", 'RECURRENT_PARENT,a,"x, y"', "donor_parent,b,", "progeny,c,", "other,c,")
    samples, violations = manifest.parse_samples(rows)
    assert samples.filter("sample_id = 'a'").first()["notes"] == "x, y"
    assert {r["kind"] for r in violations.collect()} == {"unknown role", "duplicate sample_id"}


def test_kasp_grid_orientation(spark):
    markers = spark.createDataFrame([("m1", "Gm01", 5), ("m2", "Gm01", 3)], "marker_id string, chrom string, pos_bp bigint")
    calls, bad = kasp.parse_grid(as_lines(spark, "dna,s1,s2", "m1,A:A,A:G", "m2,?,odd"), markers)
    assert {(r["marker_id"], r["sample_id"], r["call"], r["reason"]) for r in calls.collect()} == {
        ("m1", "s1", "AA", None), ("m1", "s2", "AG", None), ("m2", "s1", None, "?"), ("m2", "s2", None, "unrecognized")}
    assert bad.count() == 0
    wide, order = kasp.wide_table(calls, markers)
    assert [(r["marker_id"], r["cells"]) for r in wide.orderBy("pos_bp").collect()] == [("m2", "N,N"), ("m1", "AA,AG")]
    assert [r["sample_id"] for r in order.orderBy("place").collect()] == ["s1", "s2"]
    assert kasp.parse_grid(as_lines(spark, "dna,p,q", "r,A:A,A:G"), markers)[1].count() == 1


def test_number_text(spark):
    values = [0.5, 1 / 3, 1e-5, 123456.7, 1e6, 0.0, -2.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(number_text(F.col("x"))).collect()] == ["0.5", "0.333333", "1e-05", "123457", "1000000", "0", "-2.5", "NA"]


def kinds(violations):
    return {r["kind"] for r in violations.collect()}


def test_inputs_that_hold_nothing_or_lose_rows_are_reported(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    record = "Gm01\t5\tm\tA\tC\t.\t.\t.\tGT"
    assert kinds(vcf.parse_vcf(as_lines(spark, f"{head}\ta")).violations) == {"no records"}
    assert kinds(vcf.parse_vcf(as_lines(spark, f"{head}\ta\ta", f"{record}\t0/0\t0/1")).violations) == {"sample column occurs twice"}
    assert "no #CHROM header" in kinds(vcf.parse_vcf(as_lines(spark, f"{record}\t0/0")).violations)
    assert kinds(vcf.parse_vcf(as_lines(spark, f"{head}\ta", f"{record}\t0/0")).violations) == set()
    manifest_rows = ("sample_id,role", "a,recurrent_parent", "b,donor_parent", "c,progeny")
    assert kinds(manifest.parse_samples(as_lines(spark, *manifest_rows))[1]) == set()
    assert kinds(manifest.parse_samples(as_lines(spark, "x,progeny", *manifest_rows))[1]) == {"unexpected header"}
    assert "missing column" in kinds(manifest.parse_samples(as_lines(spark, "sample_id,line_name", "a,b"))[1])
    assert kinds(manifest.parse_marker_map(as_lines(spark, "marker_id,chrom,pos_bp,cm"))[1]) == {"no rows"}
    assert kinds(kasp.parse_long(as_lines(spark, "a,m,A:A"))[1]) == {"no header row"}


def test_kasp_job_refuses_conflicts_and_unplaced_snps(spark):
    calls, clean = kasp.parse_long(as_lines(spark, "SubjectID,SNPID,Call", "a,m1,A:A", "a,m1,G:G", "b,m1,A:G", "b,m9,A:A"))
    assert kinds(clean) == set()
    markers = spark.createDataFrame([("m1", "Gm01", 5)], "marker_id string, chrom string, pos_bp long")
    (table, order), counts, violations = kasp.wide_job(calls, markers)
    assert {(r["kind"], r["detail"]) for r in violations.collect()} == {("conflicting calls", "a m1"), ("SNP not on the map", "m9")}
    assert kinds(kasp.wide_job(calls, markers, drop_unplaced=True)[2]) == {"conflicting calls"}
    assert {r["what"]: r["n"] for r in counts.collect()} == {"unplaced SNPs": 1}
    assert [(r["marker_id"], r["cells"]) for r in table.collect()] == [("m1", "AA,AG")]
    head, body = wide_lines(table, order)
    assert [head.first()["value"], body.first()["value"]] == ["marker_id,chrom,pos_bp,a,b", "m1,Gm01,5,AA,AG"]


def test_wide_lines_of_many_samples(spark, monkeypatch):
    """Lines put together from several stretches of samples, with absent cells and absent stretches."""
    monkeypatch.setattr(kasp, "WIDE_CHUNK", 3)
    rows = [(f"s{i:02d}", m, "f", i, "AG" if i % 2 else None) for i in range(11) for m in ("m1", "m2") if m == "m1" or i in (4, 10)]
    calls = spark.createDataFrame(rows, "sample_id string, marker_id string, file string, ord long, call string")
    wide, order = kasp.wide_table(calls, spark.createDataFrame([("m1", "Gm01", 5), ("m2", "Gm01", 9)], "marker_id string, chrom string, pos_bp long"))
    got = {r["marker_id"]: r["cells"] for r in wide.collect()}
    assert got == {"m1": ",".join("AG" if i % 2 else "N" for i in range(11)), "m2": ",".join(["N"] * 11)}
    assert [r["place"] for r in order.orderBy("sample_id").collect()] == list(range(11))


def many_files(spark, n=40):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    rows = []
    for k in range(n):
        rows += [(f"f{k}", 0, "##x"), (f"f{k}", 1, f"{head}\ta{k}\tb{k}")] if k % 5 else []
        rows += [(f"f{k}", 2 + j, f"Gm01\t{j + 1}\tm{j}\tA\tC\t.\t.\t.\tGT\t0/0\t0/{k % 2}") for j in range(6)]
    return spark.createDataFrame(rows, "file string, ord long, value string")


def test_facts_of_files_are_broadcast_or_salted(spark):
    text = many_files(spark)
    facts = lines.headers(text, F.col("value").startswith("#CHROM"), "\t")
    small, large = lines.per_file(text, facts), lines.per_file(text, facts, most_bytes=0)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.select(*small.columns).collect()))
    assert small.filter("head_ord is null").count() == 8 * 6
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


@pytest.mark.parametrize("name", ["vcf", "vcf_manifest", "hapmap", "wide", "grid", "long", "linkage", "pedigree", "families"])
def test_lines_are_never_dealt_by_file(spark, name):
    """With automatic broadcasts off, no exchange of a reader's plan is keyed by the file alone."""
    text = many_files(spark, 6)
    markers = spark.createDataFrame([("m1", "Gm01", 5)], "marker_id string, chrom string, pos_bp bigint")
    families = spark.createDataFrame([("F", "a1", 0, True), ("F", "b1", 1, False)], "family string, sample_id string, place int, parent boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {
            "vcf": lambda: vcf.parse_vcf(text).calls, "vcf_manifest": lambda: vcf.parse_vcf(text, manifest=families).calls, "hapmap": lambda: grids.parse_hapmap(text).calls,
            "wide": lambda: grids.parse_wide(text, coding="nucleotide").calls, "grid": lambda: kasp.parse_grid(text, markers)[0], "long": lambda: kasp.parse_long(text)[0],
            "linkage": lambda: linkage.parse_linkage(text)[0], "pedigree": lambda: pedigree.parse_pedigrees(text), "families": lambda: pedigree.extract_families(text, families)[0],
        }[name]()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(file#\d+, \d+\)", plan), plan


def test_families_of_any_size_in_one_pass(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    text = as_lines(
        spark, "##fileformat=VCFv4.2", f"{head}\tL2\tR\tX\tL1\tD\tM1", "x.Gm01\t5\tm1\tA\tC\t.\t.\t.\tGT:DP\t0/1:3\t0/0:1\t1/1:2\t.:0\t1/1:9\t0|1:1",
        "scaffold_9\t6\tm2\tA\tC\t.\t.\t.\tGT\t0/0\t0/0\t0/0\t0/0\t0/0\t0/0", "Gm02\t7\tm3\tA\t.\t.\t.\t.\tGT\t0/0\t0/0\t0/0\t1/0\t0/0\t0/0",
    )
    members = [("F1", "R", 0, True), ("F1", "D", 1, True), ("F1", "L1", 2, False), ("F1", "L2", 3, False), ("F1", "L9", 4, False), ("F2", "R", 0, True), ("F2", "D", 1, True), ("F2", "L2", 2, False),
               ("F3", "M1", 1, False), ("F3", "P", 0, True), ("F4", "Q", 0, True)]
    families = spark.createDataFrame(members, "family string, sample_id string, place int, parent boolean")
    records, heads, violations = pedigree.extract_families(text, families)
    got = {(r["family"], r["id"]): (r["gts"], r["reject"]) for r in records.collect()}
    assert got == {
        ("F1", "m1"): (["0/0", "1/1", ".", "0/1"], None), ("F1", "m2"): (["0/0"] * 4, "off canonical chromosomes"), ("F1", "m3"): (["0/0", "0/0", "1/0", "0/0"], "allele index exceeds ALT"),
        ("F2", "m1"): (["0/0", "1/1", "0/1"], None), ("F2", "m2"): (["0/0"] * 3, "off canonical chromosomes"), ("F2", "m3"): (["0/0"] * 3, None),
    }
    assert {(r["kind"], r["detail"]) for r in violations.collect()} == {("parent has no genotype column", "F3 P"), ("family in no file", "F4")}
    with pytest.raises(lines.SourceError):
        lines.require_clean(violations)
    own = pedigree.record_lines(records, heads).filter("family = 'F1'").orderBy("ord").collect()
    assert [r["value"] for r in own] == ["##fileformat=VCFv4.2", f"{head}\tR\tD\tL1\tL2", "Gm01\t5\tm1\tA\tC\t.\t.\t.\tGT\t0/0\t1/1\t.\t0/1"]
    again = vcf.parse_vcf(pedigree.record_lines(records, heads).filter("family = 'F2'").select("file", "ord", "value"))  # what is written can be read
    assert again.violations.count() == 0 and again.calls.count() == 6
