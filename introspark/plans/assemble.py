"""The assembly job: parsed genotypes, manifest and marker map in, one checked dataset out, with all that was found on the way.

violations: part, file, ord, kind, detail. Any row means that the dataset is not to be used; ``rank.analyse`` refuses it.
warnings: part, kind, subject, value. What was changed or left out, for the user to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introspark.functions.chrom import SOYBEAN, Crop
from introspark.operators.common import duplicates, land
from introspark.operators.dataset import Dataset, absent_samples, extra_samples, keep_manifest, map_warnings, overlay_map, with_synthetic_parents
from introspark.schema import PARENT_ROLES
from introspark.sources.lines import Genotypes, SourceError

VIOLATIONS = ["part", "file", "ord", "kind", "detail"]
WARNINGS = "part string, kind string, subject string, value double"


def _found(rows: DataFrame, part: str) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), F.col("file").cast("string").alias("file"), F.col("ord").cast("string").alias("ord"), "kind", "detail")


def _broken(rows: DataFrame, kind: str, detail: str) -> DataFrame:
    return rows.select(F.lit("dataset").alias("part"), F.lit("").alias("file"), F.lit("0").alias("ord"), F.lit(kind).alias("kind"), F.col(detail).cast("string").alias("detail"))


def warning_rows(rows: DataFrame, part: str, kind, subject, value) -> DataFrame:
    """Rows in the columns of every table of warnings."""
    return rows.select(F.lit(part).alias("part"), kind.alias("kind"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))


def no_warnings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], WARNINGS)


def merged_markers(markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markers, violations): one row per marker id, its first in input order, and whether it is ``repeated``.

    Files may bring other samples at the same markers, so a marker may occur once in each; it must have one place and one
    list of alleles in all of them, and not occur twice in one.
    """
    place = F.concat_ws("|", "chrom", F.col("pos_bp").cast("string"), F.array_join("alleles", "/"))
    rows = markers.withColumn("place", place).withColumn("file", F.col("file_ord.file"))
    per_id = rows.groupBy("marker_id").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"),
        F.min_by(F.struct(*[c for c in markers.columns if c != "marker_id"]), "file_ord").alias("row"),
    )
    per_id = land(per_id, "merged-markers")
    bad = _broken(per_id.filter("low <> high"), "marker with two places or allele lists", "marker_id").unionByName(
        _broken(per_id.filter("low = high and n > n_files"), "duplicate marker_id", "marker_id"))
    return per_id.select("marker_id", "row.*", (F.col("n") > 1).alias("repeated")), bad


def assemble(genotypes: Genotypes, manifest: tuple[DataFrame, DataFrame], marker_map: tuple[DataFrame, DataFrame] | None = None, crop: Crop = SOYBEAN) -> Dataset:
    """A dataset from a parsed genotype source, ``manifest.parse_samples`` and ``manifest.parse_marker_map``.

    Calls are parsed and written once, and so are the merged markers; every later step reads these tables. The map's
    positions win. Parents that a coded input lacks are made up and announced, other samples without a genotype column are
    violations, columns outside the manifest are dropped and counted.
    """
    samples, sample_violations = manifest
    samples = land(samples, "manifest")
    in_files = land(genotypes.samples.distinct(), "file-samples")
    markers, marker_violations = merged_markers(genotypes.markers)
    calls = land(keep_manifest(genotypes.calls, samples), "dataset-calls")
    violations = _found(genotypes.violations, "genotypes").unionByName(_found(sample_violations, "samples")).unionByName(marker_violations)
    several = calls.join(markers.filter("repeated").select("marker_id"), "marker_id", "left_semi")  # else a column is once in a file
    twice = duplicates(several, "marker_id", "sample_id").select(F.concat_ws(" ", "marker_id", "sample_id").alias("cell"))
    violations = violations.unionByName(_broken(twice, "two calls of one sample at one marker", "cell"))

    markers, notes = markers.drop("repeated"), []
    if marker_map is not None:
        violations = violations.unionByName(_found(marker_map[1], "map"))
        overlaid = land(overlay_map(markers, marker_map[0].drop("file_ord")), "overlaid-markers")
        notes.append(warning_rows(map_warnings(overlaid), "map", F.col("kind"), F.col("marker_id"), F.col("n")))
        markers = overlaid.drop("in_map", "file_chrom", "file_pos_bp")
    absent = absent_samples(in_files, samples)
    data = Dataset(markers, samples, calls, crop, genotypes.token_profile, genotypes.coded)
    if genotypes.coded:
        made = absent.filter(F.col("role").isin(*PARENT_ROLES))
        notes.append(warning_rows(made, "dataset", F.lit("parent made up"), F.col("sample_id"), F.lit(None)))
        absent = absent.filter(~F.col("role").isin(*PARENT_ROLES))
        data = with_synthetic_parents(data, in_files)
    violations = violations.unionByName(_broken(absent, "sample without genotype column", "sample_id"))
    extra = extra_samples(in_files, samples).agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first")).filter("n > 0")
    notes.append(warning_rows(extra, "dataset", F.lit("columns not in the manifest"), F.col("first"), F.col("n")))
    warnings = notes[0]
    for more in notes[1:]:
        warnings = warnings.unionByName(more)
    return data.with_(violations=land(violations, "violations"), warnings=land(warnings, "warnings"))


def require_clean(dataset: Dataset) -> Dataset:
    """The dataset, if its assembly found no violation; else the first, with their number, is raised."""
    if dataset.violations is not None:
        first = F.min(F.struct("part", "file", "ord", "kind", "detail")).alias("v")
        row = dataset.violations.agg(F.count(F.lit(1)).alias("n"), first).first()
        if row["n"]:
            v = row["v"]
            raise SourceError(f"{v['part']} {v['file']}: {v['kind']}: {v['detail']} ({row['n']} violations)")
    return dataset


__all__ = ["VIOLATIONS", "WARNINGS", "assemble", "merged_markers", "no_warnings", "require_clean", "warning_rows"]
