"""Published linkage-map tables: rows with an assembly position and a linkage position, rejects named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark.functions.chrom import SOYBEAN, canonical_chrom
from introspark.functions.text import decimal_number, position
from introspark.operators.common import duplicates
from introspark.sources.lines import named_rows

# The columns of the published table.
ASSEMBLY_COLUMNS = {
    "a2": ("Wm82.a2.v1 Chromosome", "Wm82.a2.v1 Coordinate"),
    "a1": ("Glyma1.01 Chromosome", "Glyma1.01 Coordinate"),
}
MAP_COLUMNS = {"WP": ("WP Linkage Group", "WP linkage position"), "EW": ("EW Linkage Group", "EW linkage position")}


def group_chromosome(linkage_group: Column) -> Column:
    """Chromosome named by a linkage-group number 1..20, written ``1`` or ``1.0``."""
    number = decimal_number(linkage_group)
    whole = F.when((number == F.floor(number)) & number.between(1, len(SOYBEAN.chromosomes)), number.cast("int"))
    return F.try_element_at(F.array(*[F.lit(c) for c in SOYBEAN.chromosomes]), whole)


def parse_linkage(lines: DataFrame, assembly: str = "a2", map_name: str = "WP") -> tuple[DataFrame, DataFrame]:
    """(table, violations). A title row precedes the header.

    table: marker_id, snp_id, chrom, pos_bp, cm, placed, reject, file_ord; ``reject`` names the first step a row fails.
    """
    chrom_name, pos_name = ASSEMBLY_COLUMNS[assembly]
    group_name, cm_name = MAP_COLUMNS[map_name]
    rows = named_rows(lines, ("ss ID", "SNP ID", chrom_name, pos_name, group_name, cm_name), exact=True)
    number = F.col("`ss ID`").try_cast("double")
    parsed = rows.select(
        "file", "ord", F.col("`ss ID`").alias("raw_id"),
        F.when(number.isNotNull() & ~F.isnan(number), F.concat(F.lit("ss"), number.try_cast("bigint").cast("string"))).alias("marker_id"),
        F.coalesce("`SNP ID`", F.lit("")).alias("snp_id"),
        canonical_chrom(F.coalesce(F.col(f"`{chrom_name}`"), F.lit(""))).alias("chrom"),
        position(F.coalesce(F.col(f"`{pos_name}`"), F.lit(""))).alias("pos_bp"),
        F.coalesce(F.col(f"`{group_name}`"), F.lit("")).alias("lg"), decimal_number(F.col(f"`{cm_name}`")).alias("cm"),
    )
    placed = F.col("pos_bp").isNotNull() & F.col("chrom").isin(*SOYBEAN.chromosomes)
    reject = (
        F.when(~placed, "no position on assembly")
        .when((F.col("lg") == "") | F.col("cm").isNull(), "no linkage position on map")
        .when(F.coalesce(group_chromosome(F.col("lg")) != F.col("chrom"), F.lit(True)), "LG mismatch")
    )
    broken = parsed.filter("marker_id is null").select("file", "ord", F.lit("invalid ss ID").alias("kind"), F.coalesce("raw_id", F.lit("")).alias("detail"))
    good = parsed.filter("marker_id is not null")
    repeated = (
        duplicates(good, "marker_id").join(good.groupBy("marker_id").agg(F.min("file").alias("file"), F.max("ord").alias("ord")), "marker_id")
        .select("file", "ord", F.lit("duplicate marker").alias("kind"), F.col("marker_id").alias("detail"))
    )
    table = good.select("marker_id", "snp_id", "chrom", "pos_bp", "cm", placed.alias("placed"), reject.alias("reject"), F.struct("file", "ord").alias("file_ord"))
    return table, broken.unionByName(repeated)
