"""Dataset assembly: map overlay, manifest join, synthetic parents, and the warnings of each step."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introspark.functions.chrom import SOYBEAN, Crop, chrom_order
from introspark.operators.common import duplicates
from introspark.schema import PARENT_ROLES, PROGENY_ROLES


@dataclass(frozen=True)
class Dataset:
    """One analysis input.

    markers: marker_id, chrom, pos_bp, cm, file_ord. samples: the manifest. calls: one row per
    (marker_id, sample_id) that was read; a cell without a row is a missing call, as is a NULL side. parents: the
    parents' calls as a table of their own, where the source can give it, so that looking them up reads no other call.
    violations and warnings: what the assembly from files found, as of ``plans.assemble``; None for tables made elsewhere.
    """

    markers: DataFrame
    samples: DataFrame
    calls: DataFrame
    crop: Crop = SOYBEAN
    token_profile: str = "default"
    coded: bool = False
    call_sets: DataFrame | None = None
    parents: DataFrame | None = None
    violations: DataFrame | None = None
    warnings: DataFrame | None = None

    def with_(self, **changes) -> Dataset:
        return replace(self, **changes)

    @property
    def progeny(self) -> DataFrame:
        return self.samples.filter(F.col("role").isin(*PROGENY_ROLES))

    def parent_calls(self) -> DataFrame:
        """Calls of the two parents with their role, from their own table where there is one.

        The manifest must name exactly one parent of each role; their ids reach the scan of the calls as literals.
        """
        named = self.samples.filter(F.col("role").isin(*PARENT_ROLES)).select("sample_id", "role").limit(len(PARENT_ROLES) + 1).collect()
        if sorted(r["role"] for r in named) != sorted(PARENT_ROLES):
            raise ValueError(f"the manifest must name one sample of each role {PARENT_ROLES}, not {[tuple(r) for r in named]}")
        role = F.lit(None).cast("string")
        for r in named:
            role = F.when(F.col("sample_id") == r["sample_id"], r["role"]).otherwise(role)
        calls = self.calls if self.parents is None else self.parents
        return calls.filter(F.col("sample_id").isin([r["sample_id"] for r in named])).withColumn("role", role)


def overlay_map(markers: DataFrame, marker_map: DataFrame) -> DataFrame:
    """Map positions win; markers absent from the map keep the file's position and get no cM.

    Adds ``in_map`` and the file's own ``file_chrom``/``file_pos_bp``.
    """
    listed = marker_map.select(
        "marker_id", F.col("chrom").alias("_chrom"), F.col("pos_bp").alias("_pos"), F.col("cm").alias("_cm"), F.lit(True).alias("in_map")
    )
    return (
        markers.drop("cm")
        .join(listed, "marker_id", "left")
        .withColumn("in_map", F.coalesce("in_map", F.lit(False)))
        .withColumnsRenamed({"chrom": "file_chrom", "pos_bp": "file_pos_bp"})
        .withColumn("chrom", F.when(F.col("in_map"), F.col("_chrom")).otherwise(F.col("file_chrom")))
        .withColumn("pos_bp", F.when(F.col("in_map"), F.col("_pos")).otherwise(F.col("file_pos_bp")))
        .withColumn("cm", F.col("_cm"))
        .drop("_chrom", "_pos", "_cm")
    )


def map_warnings(overlaid: DataFrame) -> DataFrame:
    """(seq, kind, marker_id, n): a row per marker that the map moved, then one with the number of markers it lacks.

    All are returned, moved markers by (file_ord); a caller that prints them limits what it prints.
    """
    moved = overlaid.filter("in_map and (chrom <> file_chrom or pos_bp <> file_pos_bp)").select(
        F.col("file_ord").alias("seq"), F.lit("moved").alias("kind"), "marker_id", F.col("pos_bp").alias("n"))
    absent = overlaid.filter("not in_map").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(None).cast(overlaid.schema["file_ord"].dataType).alias("seq"), F.lit("not on the map").alias("kind"), F.lit(None).cast("string").alias("marker_id"), "n")
    return moved.unionByName(absent)


def keep_manifest(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Only the samples of the manifest."""
    return calls.join(samples.select("sample_id"), "sample_id", "left_semi")


def absent_samples(file_samples: DataFrame, samples: DataFrame) -> DataFrame:
    """Manifest samples without a genotype column: an error for the caller."""
    return samples.join(file_samples.select("sample_id"), "sample_id", "left_anti")


def extra_samples(file_samples: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotype columns the manifest does not list: dropped with a warning."""
    return file_samples.join(samples.select("sample_id"), "sample_id", "left_anti")


def with_synthetic_parents(dataset: Dataset, file_samples: DataFrame) -> Dataset:
    """For coded input, parents absent from the file are added: the recurrent parent all A, the donor all B.

    The two literal parents are exploded per marker row, so nothing is joined.
    """
    roles = F.array(
        *[F.struct(F.lit(role).alias("role"), F.lit(allele).alias("allele"))
          for role, allele in (("recurrent_parent", 0), ("donor_parent", 1))]
    )
    wanted = absent_samples(file_samples, dataset.samples).select("sample_id", "role")
    made = (
        dataset.markers.select("marker_id", F.inline(roles))
        .join(F.broadcast(wanted.filter(F.col("role").endswith("_parent"))), "role")  # at most two rows
        .select("marker_id", "sample_id", F.col("allele").alias("a1"), F.col("allele").alias("a2"))
    )
    return dataset.with_(calls=dataset.calls.unionByName(made))


def ordered_markers(markers: DataFrame, crop: Crop = SOYBEAN) -> DataFrame:
    """Markers with ``chrom_rank``: sorting by (chrom_rank, pos_bp, file_ord) is the analysis order."""
    return markers.withColumn("chrom_rank", chrom_order(F.col("chrom"), crop))


def has_cm(markers: DataFrame) -> DataFrame:
    """One row: whether every marker has a map position."""
    return markers.agg(F.coalesce(F.every(F.col("cm").isNotNull()), F.lit(True)).alias("has_cm"))


def duplicate_ids(dataset: Dataset) -> DataFrame:
    """Ids that break uniqueness, by kind."""
    parts = [
        duplicates(dataset.markers, "marker_id").select(F.lit("marker_id").alias("kind"), F.col("marker_id").alias("id"), "n_rows"),
        duplicates(dataset.samples, "sample_id").select(F.lit("sample_id").alias("kind"), F.col("sample_id").alias("id"), "n_rows"),
    ]
    return parts[0].unionByName(parts[1])

