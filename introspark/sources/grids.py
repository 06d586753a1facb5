"""HapMap and wide CSV: one marker per row, one sample per column.

All cells of a marker are in its row, so its alleles are found and its calls encoded inside the row: no
shuffle until somebody needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions import calls as C
from introspark.functions.chrom import SOYBEAN, Crop, canonical_chrom
from introspark.functions.text import position, strip
from introspark.operators.common import computed_once, land
from introspark.sources.lines import Genotypes, SourceError, data_rows, early_rows, headed, headers, read_lines, repeated_columns

HAPMAP_FIXED = 11
WIDE_FIXED = ("marker_id", "chrom", "pos_bp")


def _genotypes(rows: DataFrame, whole: DataFrame, parse, seeds: Column, coded: bool, label: str) -> Genotypes:
    """From rows(file, ord, kind, marker_id, chrom, pos_bp, names, tokens): alleles, calls and violations.

    Markers, calls, samples and violations read the parsed rows, which are written once.
    """
    fixed = ["file", "ord", "kind", "marker_id", "chrom", "pos_bp", "names"]
    good = F.col("kind").isNull()
    parsed = computed_once(rows.withColumn("seeds", seeds), [*fixed, "seeds", "tokens"], c=F.when(good, F.transform(F.transform("tokens", C.token), parse)))
    parsed = computed_once(parsed, [*fixed, "tokens"], c=C.resolve_marker(F.col("c"), F.col("seeds")))
    bad = F.filter(F.arrays_zip("tokens", "c"), lambda x: x["c"]["kind"] == "bad")
    parsed = computed_once(
        parsed, [*fixed, "c"], alleles=F.array(F.lit("A"), F.lit("B")) if coded else C.marker_alleles(F.col("c")),
        broken=F.when(F.exists("c", lambda x: x["kind"] == "bad"), F.coalesce(F.element_at(bad, 1)["tokens"], F.lit(""))),
    )
    everything = land(parsed, "parsed-rows")
    parsed = everything.filter("kind is null")
    a1, a2 = C.encode(F.col("cell.c"), F.col("alleles"))
    exploded = parsed.select("marker_id", "alleles", F.explode(F.arrays_zip("names", "c")).alias("cell"))
    violations = everything.filter("kind is not null").select("file", "ord", "kind", F.coalesce("marker_id", F.lit("")).alias("detail")).unionByName(
        parsed.filter("broken is not null").select("file", "ord", F.lit("unrecognised call").alias("kind"), F.concat_ws(" ", "marker_id", "broken").alias("detail"))
    )
    return Genotypes(
        markers=parsed.filter("broken is null").select(
            "marker_id", "chrom", "pos_bp", F.lit(None).cast("double").alias("cm"), F.struct("file", "ord").alias("file_ord"), "alleles"
        ),
        calls=exploded.filter("cell.c.kind <> 'bad'").select("marker_id", F.col("cell.names").alias("sample_id"), a1.alias("a1"), a2.alias("a2")),
        samples=everything.select("names").distinct().select(F.explode("names").alias("sample_id")).distinct(),
        violations=violations.unionByName(whole),
        coded=coded,
        token_profile=label,
    )


def _judged(rows: DataFrame, fixed: int, header_ok: Column, marker: Column, chrom: Column, pos: Column, crop: Crop) -> DataFrame:
    width = F.size("header")
    rest = F.greatest(width - fixed, F.lit(0))
    once = computed_once(
        rows, ["file", "ord", "cells", "header"], marker_id=marker, chrom=canonical_chrom(chrom, crop), pos_bp=position(pos),
        names=F.slice("header", fixed + 1, rest), tokens=F.slice("cells", fixed + 1, rest),
    )
    kind = (
        F.when(~header_ok, "unexpected header")
        .when(F.size("cells") != width, "wrong number of columns")
        .when(F.col("marker_id") == "", "empty marker_id")
        .when(F.col("pos_bp").isNull(), "invalid position")
    )
    return once.withColumn("kind", kind)


def read_hapmap(spark: SparkSession, path: str, profile=None, crop: Crop = SOYBEAN) -> Genotypes:
    return parse_hapmap(read_lines(spark, path), profile, crop)


def parse_hapmap(lines: DataFrame, profile=None, crop: Crop = SOYBEAN) -> Genotypes:
    vocabulary = C.profile(profile)
    heads = headers(lines, F.lower("value").startswith("rs#"), "\t")
    text = headed(lines, heads)
    rows = data_rows(text)

    def column(i: int) -> Column:
        return F.try_element_at("cells", F.lit(i))

    header_ok = F.size("header") > HAPMAP_FIXED
    judged = _judged(rows, HAPMAP_FIXED, header_ok, column(1), column(3), column(4), crop)
    listed = F.transform(F.split(F.try_element_at("cells", F.lit(2)), "/"), lambda a: F.upper(strip(a)))
    seeds = F.filter(listed, lambda a: ~a.isin("", "N"))
    label = vocabulary.label if vocabulary else "default"
    return _genotypes(judged, _whole(text, heads, HAPMAP_FIXED), lambda t: C.nucleotide_call(t, True, vocabulary), seeds, False, label)


def _whole(text: DataFrame, heads: DataFrame, fixed: int) -> DataFrame:
    """Violations no row shows: content before a header, and sample columns that occur twice."""
    names = F.transform(F.slice("header", fixed + 1, F.greatest(F.size("header") - fixed, F.lit(0))), strip)
    return early_rows(text).unionByName(repeated_columns(heads.select("file", names.alias("names"))))


def detect_coding(rows: DataFrame, claimed: list[str]) -> DataFrame:
    """One row: whether every voting cell is A, B or H and some cell is B or H."""
    voting = F.filter(F.transform("tokens", C.token), lambda t: C.votes_for_coding(t, claimed))
    rows = computed_once(rows, [], voting=voting)
    voting = F.col("voting")
    return rows.select(
        F.forall(voting, lambda t: t.isin("A", "B", "H")).alias("only"), F.exists(voting, lambda t: t.isin("B", "H")).alias("some")
    ).agg((F.coalesce(F.every("only"), F.lit(False)) & F.coalesce(F.some("some"), F.lit(False))).alias("coded"))


def read_wide(spark: SparkSession, path: str, coding: str = "auto", profile=None, crop: Crop = SOYBEAN) -> Genotypes:
    return parse_wide(read_lines(spark, path), coding, profile, crop)


def _wide_heads(lines: DataFrame) -> DataFrame:
    return headers(lines, F.lower("value").rlike(r'^[\s"]*marker_id'))


def wide_rows(lines: DataFrame, crop: Crop = SOYBEAN) -> DataFrame:
    return _wide_rows(headed(lines, _wide_heads(lines)), crop)


def wide_tokens(lines: DataFrame) -> DataFrame:
    """(tokens): the sample cells of every row of ``wide_rows``, whose places and names are not read."""
    rows = data_rows(headed(lines, _wide_heads(lines)))
    return rows.select(F.slice("cells", len(WIDE_FIXED) + 1, F.greatest(F.size("header") - len(WIDE_FIXED), F.lit(0))).alias("tokens"))


def _wide_rows(text: DataFrame, crop: Crop) -> DataFrame:
    rows = data_rows(text).withColumn("header", F.transform("header", strip))
    cell = [F.try_element_at("cells", F.lit(i)) for i in (1, 2, 3)]
    header_ok = (F.slice(F.transform("header", F.lower), 1, 3) == F.array(*[F.lit(c) for c in WIDE_FIXED])) & (F.size("header") > 3)
    return _judged(rows, 3, header_ok, strip(cell[0]), cell[1], cell[2], crop)


def parse_wide(lines: DataFrame, coding: str = "auto", profile=None, crop: Crop = SOYBEAN) -> Genotypes:
    """``coding`` is nucleotide, abh or auto; auto takes one aggregate over all cells to decide."""
    vocabulary = C.profile(profile)
    heads = _wide_heads(lines)
    text = headed(lines, heads)
    rows = _wide_rows(text, crop)
    if coding == "auto":
        if vocabulary is not None and vocabulary.base == "none":
            coding = "nucleotide"
        else:
            coding = "abh" if detect_coding(rows, vocabulary.tokens() if vocabulary else []).first()["coded"] else "nucleotide"
    if vocabulary is not None and coding == "abh":
        raise SourceError(f"token profile {vocabulary.profile_id} does not apply to an A/B/H-coded file")
    none, whole = F.array().cast("array<string>"), _whole(text, heads, len(WIDE_FIXED))
    if coding == "abh":
        return _genotypes(rows, whole, C.coded_call, none, True, "default")
    return _genotypes(rows, whole, lambda t: C.nucleotide_call(t, False, vocabulary), none, False, vocabulary.label if vocabulary else "default")
