"""One backcross family from a pedigree list and a genotype file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introspark.functions.text import after_last_dot
from introspark.operators.common import computed_once, land
from introspark.sources.lines import content, first_by, named_rows, per_file
from introspark.sources.vcf import FIXED, file_headers

PEDIGREE_COLUMNS = ("Line", "Female Parent", "Male Parent")
# The columns of a VCF before its samples.
VCF_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
# Fixed value: canonical chromosome names kept by the extraction.
CHROMOSOME = "^Gm(0[1-9]|1[0-9]|20)$"


def parse_pedigrees(lines: DataFrame) -> DataFrame:
    rows = named_rows(lines, PEDIGREE_COLUMNS, exact=True)
    empty = F.lit("")
    return rows.select(
        "file", "ord", F.coalesce("Line", empty).alias("line"), F.coalesce("`Female Parent`", empty).alias("female"), F.coalesce("`Male Parent`", empty).alias("male")
    )


def family(pedigrees: DataFrame, recurrent: str, recurrent_id: str, donor: str) -> DataFrame:
    """(line, cross, n_doses): lines of one recurrent x donor cross, the first matching row of each line.

    One parent is the recurrent line, the other reads ``<recurrent> (<n>) x <donor>``; both orientations count.
    """
    pattern = f"^{re.escape(recurrent)} \\(([0-9]+)\\) x (.+)$"
    sides = F.array(F.struct(F.col("female").alias("a"), F.col("male").alias("b")), F.struct(F.col("male").alias("a"), F.col("female").alias("b")))
    matches = (
        pedigrees.filter(F.col("line").startswith("PI"))
        .select("file", "ord", "line", F.posexplode(sides).alias("side", "x"))
        .filter(F.col("x.a").isin(recurrent_id, recurrent) & F.col("x.b").rlike(pattern))
        .filter(F.trim(F.regexp_extract("x.b", pattern, 2)) == donor)
        .select("line", "file", "ord", "side", F.col("x.b").alias("cross"), F.regexp_extract("x.b", pattern, 1).cast("int").alias("n_doses"))
    )
    return first_by(matches, ["line"], ["file", "ord", "side"]).select("line", "cross", "n_doses")


def members_in_file(lines: DataFrame, header_samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Family lines with a genotype column, and those without."""
    known = header_samples.select(F.col("sample_id").alias("line"))
    return lines.join(known, "line", "left_semi"), lines.join(known, "line", "left_anti")


def family_manifest(present: DataFrame, recurrent: str, recurrent_id: str, donor: str, donor_id: str, generation: str = "") -> DataFrame:
    """The family's samples.csv rows. ``generation`` may use ``{n}`` for the number of doses."""
    spark = present.sparkSession
    schema = "sample_id string, line_name string, role string, generation string, family_id string, notes string"
    parents = spark.createDataFrame(
        [(recurrent_id, recurrent, "recurrent_parent", "", "", "recurrent parent"), (donor_id, donor, "donor_parent", "", "", "donor parent")], schema
    )
    label = F.replace(F.lit(generation), F.lit("{n}"), F.col("n_doses").cast("string"))
    return parents.unionByName(present.select(
        F.col("line").alias("sample_id"), F.col("line").alias("line_name"), F.lit("candidate").alias("role"), label.alias("generation"),
        F.lit(f"{recurrent}_x_{donor}").alias("family_id"), F.col("cross").alias("notes"),
    ))


def family_cuts(heads: DataFrame, families: DataFrame) -> DataFrame:
    """(file, family, samples, at, lost): where the members of ``families`` (family, sample_id, place, parent) stand in each file.

    ``heads`` has file, header_ord and names. Members go by ``place``; lines without a column are left out, ``lost`` names
    the parents without one. Only names meet: a row per sample column and per member.
    """
    columns = heads.select("file", F.posexplode("names").alias("i", "sample_id")).select("file", "sample_id", (F.col("i") + FIXED + 1).alias("at"))
    columns = columns.groupBy("file", "sample_id").agg(F.min("at").alias("at"))
    found = columns.join(families, "sample_id").groupBy("file", "family").agg(F.array_sort(F.collect_list(F.struct("place", "sample_id", "at", "parent"))).alias("m"))
    parents = families.filter("parent").groupBy("family").agg(F.array_sort(F.collect_set("sample_id")).alias("parents"))
    there = F.transform(F.filter("m", lambda x: x["parent"]), lambda x: x["sample_id"])
    return found.join(parents, "family", "left").select(
        "file", "family", F.col("m.sample_id").alias("samples"), F.col("m.at").alias("at"),
        F.array_except(F.coalesce("parents", F.array().cast("array<string>")), there).alias("lost"),
    )


def extract_families(lines: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, heads, violations): all families' columns of VCF files, cut in one pass over the lines.

    ``families`` has family, sample_id, place and parent; a file gives every family of which it has a member. records:
    family, file, ord, chrom, pos, id, ref, alt, gts, reject, where ``reject`` names the first step a record fails. heads:
    family, file, samples. violations: a family whose parent has no column in a file that holds its lines, and a family in
    no file at all; such families give no records.
    """
    text = content(lines).filter(~F.col("value").startswith("##"))
    headed = file_headers(text, None)
    cuts = land(family_cuts(headed, families), "family-cuts")
    whole = cuts.filter(F.size("lost") == 0)
    per = land(headed.select("file", "header_ord").join(whole.groupBy("file").agg(F.collect_list(F.struct("family", "at")).alias("cuts")), "file"), "file-cuts")
    rows = per_file(text, per, "inner").filter((F.col("ord") > F.col("header_ord")) & ~F.col("value").startswith("#"))
    rows = computed_once(rows, ["file", "ord", "cuts"], f=F.split("value", "\t", -1))
    field = lambda i: F.try_element_at("f", F.lit(i))
    rows = rows.select(
        "file", "ord", after_last_dot(field(1)).alias("chrom"), field(2).alias("pos"), field(3).alias("id"), field(4).alias("ref"), field(5).alias("alt"), "f", F.inline("cuts"),
    )
    gts = F.transform("at", lambda i: F.substring_index(F.try_element_at("f", i), ":", 1))
    n_alt = F.when(F.col("alt") == ".", 0).otherwise(F.size(F.split("alt", ",")))
    picked = computed_once(rows, ["family", "file", "ord", "chrom", "pos", "id", "ref", "alt"], gts=gts, n_alt=n_alt)
    # most alleles may be missing, and a cast that fails costs many times one that does not
    index = lambda a: F.when(~a.isin(".", ""), a.try_cast("int"))
    beyond = F.exists(F.flatten(F.transform("gts", lambda g: F.split(F.translate(g, "|", "/"), "/"))), lambda a: index(a) > F.col("n_alt"))
    reject = F.when(~F.col("chrom").rlike(CHROMOSOME), "off canonical chromosomes").when(beyond, "allele index exceeds ALT")
    nowhere = families.select("family").distinct().join(cuts.select("family"), "family", "left_anti")
    violations = cuts.filter(F.size("lost") > 0).select(
        "file", F.lit(0).alias("ord"), F.lit("parent has no genotype column").alias("kind"), F.concat_ws(" ", "family", F.array_join("lost", " ")).alias("detail")
    ).unionByName(nowhere.select(F.lit("").alias("file"), F.lit(0).alias("ord"), F.lit("family in no file").alias("kind"), F.col("family").alias("detail")))
    return picked.withColumn("reject", reject).drop("n_alt"), whole.select("family", "file", "samples"), violations


def record_lines(records: DataFrame, heads: DataFrame) -> DataFrame:
    """(family, file, ord, value): every family as a VCF of its own: two header lines, then the kept records in file order."""
    fixed = ["chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT")]
    body = records.filter("reject is null").select("family", "file", F.col("ord").cast("bigint").alias("ord"), F.concat_ws("\t", *fixed, F.array_join("gts", "\t")).alias("value"))
    names = F.concat(F.lit("\t".join(VCF_COLUMNS)), F.lit("\t"), F.array_join("samples", "\t"))
    top = F.array(F.struct(F.lit(-2).cast("bigint").alias("ord"), F.lit("##fileformat=VCFv4.2").alias("value")), F.struct(F.lit(-1).cast("bigint").alias("ord"), names.alias("value")))
    return body.unionByName(heads.select("family", "file", F.inline(top)))


def reject_counts(records: DataFrame, *by: str) -> DataFrame:
    """Records by the step that rejects them, or ``written``."""
    return records.groupBy(*by, F.coalesce("reject", F.lit("written")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
