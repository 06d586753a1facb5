"""VCF 4.2+ text to markers and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.calls import genotype_of, genotype_sides
from introspark.functions.chrom import SOYBEAN, Crop, canonical_chrom
from introspark.functions.text import position
from introspark.operators.common import computed_once, land
from introspark.sources.lines import Genotypes, content, per_file, read_lines, repeated_columns

FIXED = 9


def read_vcf(spark: SparkSession, path: str, crop: Crop = SOYBEAN, manifest: DataFrame | None = None, parts: bool = False) -> Genotypes:
    return parse_vcf(read_lines(spark, path, parts), crop, manifest)


def file_headers(text: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(file, header_ord, width, formed, names, wanted): a written row per file of ``text``.

    The header line's place (NULL without one) and width, whether it has FORMAT and a sample column, its sample names, and
    the sample columns wanted from it. Header lines are aggregated where they are read.
    """
    # numbers alone meet per file, so the lines are not sorted for it; the header lines themselves are few
    head = F.col("value").startswith("#CHROM")
    files = text.groupBy("file").agg(F.min(F.when(head, F.col("ord"))).alias("header_ord"))
    said = text.filter(head).groupBy("file").agg(F.min_by("value", "ord").alias("header"))
    first = files.join(said, "file", "left").withColumn("header", F.split("header", "\t", -1))
    names = F.slice("header", FIXED + 1, F.greatest(F.size("header") - FIXED, F.lit(0)))
    out = first.select(
        "file", "header_ord", F.size("header").alias("width"), ((F.size("header") > FIXED) & (F.try_element_at("header", F.lit(9)) == "FORMAT")).alias("formed"), names.alias("names"),
    )
    columns = F.transform("names", lambda s, i: F.struct((i + FIXED + 1).alias("at"), s.alias("sample_id")))
    out = land(out.withColumn("wanted", columns), "vcf-headers")
    if manifest is not None:
        # columns outside the manifest are dropped before any cell is exploded
        listed = (
            out.select("file", F.inline("wanted")).join(manifest.select("sample_id"), "sample_id", "left_semi")
            .groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "sample_id"))).alias("wanted"))
        )
        listed = out.drop("wanted").join(listed, "file", "left")
        out = land(listed.withColumn("wanted", F.coalesce("wanted", F.array().cast("array<struct<at:int,sample_id:string>>"))), "vcf-wanted")
    return out


def _whole_input(heads: DataFrame, markers: DataFrame) -> DataFrame:
    """Violations no single line shows: a file without its header, a sample column that occurs twice, an input without records."""
    bare = heads.filter("header_ord is null").select("file", F.lit("no #CHROM header").alias("kind"), F.lit("").alias("detail"))
    empty = markers.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("").alias("file"), F.lit("no records").alias("kind"), F.lit("").alias("detail"))
    return bare.unionByName(empty).withColumn("ord", F.lit(0)).unionByName(repeated_columns(heads))


def parse_vcf(lines: DataFrame, crop: Crop = SOYBEAN, manifest: DataFrame | None = None) -> Genotypes:
    """Records become markers; every wanted sample column of a record becomes one call.

    A broken line is a row of ``violations`` and yields no marker and no call. Of its file's header a line meets no more
    than what judges it and the columns wanted.
    """
    text = content(lines).filter(~F.col("value").startswith("##"))
    heads = file_headers(text, manifest)
    rows = per_file(text, heads.select("file", "header_ord", "width", "formed", "wanted"))
    rows = rows.filter(F.col("header_ord").isNull() | (F.col("ord") != F.col("header_ord")))
    rows = computed_once(rows, ["file", "ord", "value", "header_ord", "width", "formed", "wanted"], f=F.split("value", "\t", -1))

    def column(i: int):
        return F.try_element_at("f", F.lit(i))

    alt = F.when(column(5).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(column(5), ","))
    rows = computed_once(
        rows, rows.columns, pos_bp=position(column(2), digits_only=True), gt_at=F.array_position(F.split(column(9), ":"), "GT").cast("int"),
        chrom=canonical_chrom(column(1), crop), alleles=F.concat(F.array(column(4)), alt),
    )
    kind = (
        F.when(F.col("header_ord").isNull() | (F.col("ord") < F.col("header_ord")), "data line before the #CHROM header")
        .when(F.col("value").startswith("#"), "line beginning with # after the header")
        .when(~F.col("formed"), "header needs FORMAT and a sample column")
        .when(F.size("f") != F.col("width"), "wrong number of columns")
        .when(F.coalesce("gt_at", F.lit(0)) == 0, "FORMAT has no GT")
        .when(F.col("pos_bp").isNull(), "invalid position")
    )
    name = F.when(column(3).isin(".", ""), F.concat_ws("_", column(1), F.col("pos_bp").cast("string"))).otherwise(column(3))
    judged = computed_once(rows, rows.columns, kind=kind, marker_id=name)
    tokens = F.transform(
        "wanted",
        lambda w: F.struct(
            w["sample_id"].alias("sample_id"),
            F.coalesce(F.try_element_at(F.split(F.element_at("f", w["at"]), ":"), F.col("gt_at")), F.lit(".")).alias("gt"),
        ),
    )
    # markers, calls and violations read the split records
    good = F.col("kind").isNull()
    judged = land(judged.select(
        "file", "ord", "kind", F.when(~good, F.substring("value", 1, 60)).alias("detail"), "marker_id", "chrom", "pos_bp", "alleles", F.when(good, tokens).alias("cells"),
    ), "vcf-records")
    records = judged.filter("kind is null")
    cells = records.select("file", "ord", "marker_id", F.size("alleles").alias("n"), F.inline("cells"))
    cells = computed_once(cells, cells.columns, **genotype_sides(F.col("gt")))
    cells = computed_once(cells, ["file", "ord", "marker_id", "sample_id", "gt"], call=genotype_of(*[F.col(c) for c in ("gt", "first", "second", "n")]))
    broken = judged.filter("kind is not null").select("file", "ord", "kind", "detail")
    bad_cells = cells.filter("call.problem is not null").select("file", "ord", F.col("call.problem").alias("kind"), F.concat_ws(" ", "marker_id", "sample_id", "gt").alias("detail"))
    return Genotypes(
        markers=records.select("marker_id", "chrom", "pos_bp", F.lit(None).cast("double").alias("cm"), F.struct("file", "ord").alias("file_ord"), "alleles"),
        calls=cells.filter("call.problem is null").select("marker_id", "sample_id", "call.a1", "call.a2"),
        samples=heads.select(F.explode("wanted.sample_id").alias("sample_id")).distinct(),
        violations=broken.unionByName(bad_cells).unionByName(_whole_input(heads, records)),
    )
