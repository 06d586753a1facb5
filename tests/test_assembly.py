"""The assembly job: one planted fault of each kind, made-up parents, and the refusal of a dirty dataset."""

import pytest

from introspark.config import criteria_from_dict
from introspark.plans import assemble, rank
from introspark.sources import grids, manifest, vcf
from introspark.sources.lines import SourceError

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
MANIFEST = ("sample_id,role,generation,family_id", "r,recurrent_parent,,", "d,donor_parent,,", "x,progeny,BC1F1,F", "y,progeny,BC1F1,F")
CRITERIA = {"targets": [{"id": "T", "region": "Gm01:1-1000"}], "flank_unit": "bp", "background": {"map_unit": "bp"}}


def as_lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file string, ord bigint, value string")


def record(name, pos, *gts):
    return f"Gm01\t{pos}\t{name}\tA\tC\t.\t.\t.\tGT\t" + "\t".join(gts)


def found(rows):
    return {(r["part"], r["kind"], r["detail"]) for r in rows.collect()}


def test_clean_files_make_a_dataset(spark):
    text = as_lines(spark, f"{HEAD}\tx\td\tr\tz", record("m1", 5, "0/1", "1/1", "0/0", "0/0"), record("m2", 9, "0/0", "1/1", "0/0", "0/0"))
    other = as_lines(spark, f"{HEAD}\ty", record("m1", 5, "0/0"), record("m2", 9, "./."), file="g")  # the same markers, another sample
    places = manifest.parse_marker_map(as_lines(spark, "marker_id,chrom,pos_bp,cm", "m1,Gm01,6,0.5"))
    data = assemble.assemble(vcf.parse_vcf(text.unionByName(other)), manifest.parse_samples(as_lines(spark, *MANIFEST)), places)
    assert found(data.violations) == set()
    assert {(r["part"], r["kind"], r["subject"], r["value"]) for r in data.warnings.collect()} == {
        ("map", "moved", "m1", 6.0), ("map", "not on the map", None, 1.0), ("dataset", "columns not in the manifest", "z", 1.0)}
    assert {(r["marker_id"], r["pos_bp"], r["cm"]) for r in data.markers.collect()} == {("m1", 6, 0.5), ("m2", 9, None)}
    assert data.calls.count() == 8 and assemble.require_clean(data) is data
    run = rank.analyse(data, criteria_from_dict(CRITERIA))
    assert rank.results(run).count() == 2
    assert {r["part"] for r in rank.run_warnings(run).collect()} >= {"map", "dataset"}


def test_every_fault_is_a_row_and_analyse_refuses(spark):
    text = as_lines(
        spark, f"{HEAD}\tx\td\tr\tx", record("m1", 5, "0/1", "1/1", "0/0", "0/1"), record("m1", 5, "0/1", "1/1", "0/0", "0/1"), record("m2", "3e4", "0/1", "1/1", "0/0", "0/1"),
        record("m3", 7, "0/9", "1/1", "0/0", "0/1"), record("m4", 8, "0/1", "1/1", "0/0"),
    ).unionByName(as_lines(spark, f"{HEAD}\tw", record("m3", 70, "0/0"), file="g")).unionByName(as_lines(spark, record("m5", 1, "0/0"), file="h"))
    people = as_lines(spark, *MANIFEST, "x,progeny,,", "q,parent,,")
    places = manifest.parse_marker_map(as_lines(spark, "marker_id,chrom,pos_bp,cm", "m1,Gm01,5,1", "m1,Gm01,5,1", "m9,Gm01,5,one", "m8,Gm01,x,1"))
    data = assemble.assemble(vcf.parse_vcf(text), manifest.parse_samples(people), places)
    got = found(data.violations)
    assert {(part, kind) for part, kind, _ in got} == {
        ("genotypes", "sample column occurs twice"), ("genotypes", "invalid position"), ("genotypes", "allele index beyond the record's alleles"), ("genotypes", "wrong number of columns"),
        ("genotypes", "no #CHROM header"), ("genotypes", "data line before the #CHROM header"), ("samples", "duplicate sample_id"), ("samples", "unknown role"),
        ("map", "duplicate marker_id"), ("map", "invalid cm"), ("map", "invalid position"), ("dataset", "duplicate marker_id"), ("dataset", "marker with two places or allele lists"),
        ("dataset", "two calls of one sample at one marker"), ("dataset", "sample without genotype column"),
    }
    assert {d for p, k, d in got if k == "sample without genotype column"} == {"y", "q"}
    with pytest.raises(SourceError, match="violations"):
        rank.analyse(data, criteria_from_dict(CRITERIA))


def test_parents_of_coded_input_are_made_up_and_announced(spark):
    text = as_lines(spark, "marker_id,chrom,pos_bp,x,y", "m1,1,5,A,H", "m2,1,9,B,N")
    data = assemble.assemble(grids.parse_wide(text), manifest.parse_samples(as_lines(spark, *MANIFEST)))
    assert found(data.violations) == set()
    assert {(r["kind"], r["subject"]) for r in data.warnings.collect()} == {("parent made up", "r"), ("parent made up", "d")}
    assert {(r["marker_id"], r["sample_id"], r["a1"], r["a2"]) for r in data.calls.filter("sample_id in ('r', 'd')").collect()} == {
        (m, s, a, a) for m in ("m1", "m2") for s, a in (("r", 0), ("d", 1))}


@pytest.mark.parametrize("parsed", [
    lambda s: grids.parse_wide(as_lines(s, "marker_id,chrom,pos_bp,x,y,x", "m1,1,5,AA,AC,AA"), coding="nucleotide"),
    lambda s: grids.parse_hapmap(as_lines(s, "\t".join(["rs#", *"bcdefghijk", "x", "y", "x"]), "\t".join(["m1", "A/C", "1", "5", *"+......", "AA", "AC", "AA"]))),
])
def test_repeated_columns_of_every_format(spark, parsed):
    assert {(r["kind"], r["detail"]) for r in parsed(spark).violations.collect()} == {("sample column occurs twice", "x")}
