"""Saved variant-set pages (JSON): call sets, variants and allele matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.calls import linked_call_of, linked_parts
from introspark.functions.chrom import SOYBEAN, Crop, canonical_chrom
from introspark.functions.text import strip
from introspark.operators.common import computed_once, duplicates, land
from introspark.schema import CALL_SET_COLUMNS

CALL_SET_PAGE = "result struct<data: array<struct<callSetDbId: string, callSetName: string, sampleDbId: string>>>"
VARIANT_PAGE = (
    "result struct<data: array<struct<variantDbId: string, variantNames: array<string>, referenceName: string, start: double, "
    "referenceBases: string, alternateBases: array<string>>>>"
)
MATRIX_PAGE = (
    "result struct<callSetDbIds: array<string>, variantDbIds: array<string>, sepPhased: string, sepUnphased: string, unknownString: string, "
    "dataMatrices: array<struct<dataMatrixAbbreviation: string, dataMatrix: array<array<string>>>>>"
)


@dataclass(frozen=True)
class VariantSet:
    markers: DataFrame
    calls: DataFrame
    call_sets: DataFrame
    violations: DataFrame
    warnings: DataFrame


def read_pages(spark: SparkSession, folder: str, crop: Crop = SOYBEAN, marker_map: DataFrame | None = None) -> VariantSet:
    """Pages saved as callsets*, variants* and allelematrix* JSON files; each file is one page."""

    def pages(pattern: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{pattern}*.json")
        return rows.select(F.col("_metadata.file_path").alias("file"), "result")

    return parse_pages(
        pages("callsets", CALL_SET_PAGE), pages("variants", VARIANT_PAGE), pages("allelematrix", MATRIX_PAGE), crop, marker_map
    )


def page_from_json(lines: DataFrame, schema: str) -> DataFrame:
    """(file, result) from lines that each hold one page.

    A generated column: every later use of a part of the page would otherwise parse the page again.
    """
    return lines.select("file", F.explode(F.array(F.from_json("value", schema)["result"])).alias("result"))


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def call_sets(pages: DataFrame) -> DataFrame:
    """sample_id, names and ids of every call set: its name when that is unique, else its id.

    Whether a name is unique is counted per name, then joined back: a name shared by many stays one row.
    """
    rows = pages.select(F.inline("result.data")).select(
        _text(F.col("callSetName")).alias("call_set_name"), _text(F.col("callSetDbId")).alias("call_set_db_id"), _text(F.col("sampleDbId")).alias("sample_db_id")
    )
    shared = rows.groupBy("call_set_name").agg(F.count(F.lit(1)).alias("n_sharing"))
    unique = (F.col("call_set_name") != "") & (F.col("n_sharing") == 1)
    return rows.join(shared, "call_set_name").select(
        F.when(unique, F.col("call_set_name")).otherwise(F.col("call_set_db_id")).alias("sample_id"), "call_set_name", "call_set_db_id", "sample_db_id", "n_sharing"
    )


def variants(pages: DataFrame, crop: Crop = SOYBEAN, marker_map: DataFrame | None = None) -> DataFrame:
    """variant_db_id, marker_id, position, alleles, file_ord and the variant's problem, if any.

    Positions are 0-based in the pages. A variant without one takes the marker map's. ``file_ord`` orders variants by the
    number of their page (the last one in its name), the page's name, and their place in it.
    """
    rows = pages.select("file", F.posexplode("result.data").alias("place", "v")).select("file", "place", "v.*")
    names = F.filter("variantNames", lambda x: ~_text(x).isin("", "."))
    reference = _text(F.col("referenceBases"))
    others = F.transform(F.coalesce("alternateBases", F.array().cast("array<string>")), lambda b, i: F.coalesce(F.nullif(_text(b), F.lit("")), (i + 1).cast("string")))
    whole = F.col("start") == F.floor("start")
    placed = (_text(F.col("referenceName")) != "") & whole & (F.col("start") >= 0)
    number = F.coalesce(F.regexp_extract("file", r"([0-9]+)[^0-9/]*$", 1).try_cast("bigint"), F.lit(0))
    out = rows.select(
        "file", F.struct(number.alias("page"), "file", "place").alias("file_ord"), _text(F.col("variantDbId")).alias("variant_db_id"), F.coalesce(strip(F.try_element_at(names, F.lit(1))), _text(F.col("variantDbId"))).alias("marker_id"),
        F.when(placed, canonical_chrom(F.col("referenceName"), crop)).alias("chrom"), F.when(placed, F.col("start").cast("bigint") + 1).alias("pos_bp"),
        F.when(reference != "", F.concat(F.array(reference), others)).alias("alleles"), (F.col("start").isNotNull() & ~whole).alias("fractional"),
    )
    if marker_map is not None:
        at = marker_map.select("marker_id", F.col("chrom").alias("m_chrom"), F.col("pos_bp").alias("m_pos"))
        out = out.join(at, "marker_id", "left").withColumns({
            "from_map": F.col("chrom").isNull() & F.col("m_chrom").isNotNull(),
            "chrom": F.coalesce("chrom", "m_chrom"), "pos_bp": F.coalesce("pos_bp", "m_pos"),
        }).drop("m_chrom", "m_pos")
    else:
        out = out.withColumn("from_map", F.lit(False))
    problem = F.when(F.col("fractional"), "non-integer start").when(F.col("pos_bp").isNull(), "no position and not in the marker map")
    return out.withColumn("problem", problem).drop("fractional")


def _shaped(pages: DataFrame, filled: bool = False) -> DataFrame:
    """The pages whose GT matrix has the shape of its ids, with their separators; with ``filled``, those that have a cell."""
    gt = F.try_element_at(F.filter("result.dataMatrices", lambda m: m["dataMatrixAbbreviation"] == "GT"), F.lit(1))["dataMatrix"]
    # by the ids as they stand: a filter above the selection would trim them once more
    v, c = F.size("result.variantDbIds"), F.size("result.callSetDbIds")
    good = pages.withColumn("gt", gt).filter((F.size("gt") == v) & F.forall("gt", lambda row: F.size(row) == c))
    if filled:
        good = good.filter((v > 0) & (c > 0))
    return good.select(
        "file", F.transform("result.variantDbIds", strip).alias("v"), F.transform("result.callSetDbIds", strip).alias("c"), "gt",
        F.coalesce(F.nullif(_text(F.col("result.sepPhased")), F.lit("")), F.lit("|")).alias("phased"),
        F.coalesce(F.nullif(_text(F.col("result.sepUnphased")), F.lit("")), F.lit("/")).alias("unphased"),
        F.coalesce(F.nullif(_text(F.col("result.unknownString")), F.lit("")), F.lit(".")).alias("unknown"),
    )


def matrix_rows(pages: DataFrame) -> DataFrame:
    """One row per variant of the GT matrices: its id, the page's call sets, tokens and separators. Misshapen pages yield none."""
    return _shaped(pages).select("file", "c", "phased", "unphased", "unknown", F.inline(F.arrays_zip("v", "gt")))


def row_cells(rows: DataFrame, *kept: str) -> DataFrame:
    """One row per cell of ``matrix_rows``, with the columns ``kept`` of its row."""
    return rows.select("file", "phased", "unphased", "unknown", F.col("v").alias("variant_db_id"), *kept, F.inline(F.arrays_zip("c", "gt"))).select(
        "file", "variant_db_id", F.col("c").alias("call_set_db_id"), F.col("gt").alias("token"), "phased", "unphased", "unknown", *kept
    )


def matrix_cells(pages: DataFrame) -> DataFrame:
    """One row per cell of the GT matrices: ids, token and the page's separators."""
    return row_cells(matrix_rows(pages))


def page_problems(pages: DataFrame) -> DataFrame:
    """Pages without a GT matrix, misshapen, with a repeated id, or read twice."""
    gt = F.try_element_at(F.filter("result.dataMatrices", lambda m: m["dataMatrixAbbreviation"] == "GT"), F.lit(1))["dataMatrix"]
    v, c = F.col("result.variantDbIds"), F.col("result.callSetDbIds")
    kind = (
        F.when(gt.isNull(), "no GT data matrix").when(v.isNull() | c.isNull(), "ids are not an array")
        .when(F.size(F.array_distinct(v)) != F.size(v), "repeated variantDbId").when(F.size(F.array_distinct(c)) != F.size(c), "repeated callSetDbId")
        .when((F.size(gt) != F.size(v)) | F.exists(gt, lambda row: F.size(row) != F.size(c)), "matrix has the wrong shape")
    )
    single = pages.select("file", kind.alias("kind")).filter("kind is not null")
    signature = F.xxhash64(F.to_json(F.struct(v.alias("v"), c.alias("c")))), F.size(v), F.size(c)
    again = pages.select("file", *[s.alias(n) for s, n in zip(signature, ("h", "nv", "nc"), strict=True)])
    repeated = again.groupBy("h", "nv", "nc").agg(F.max("file").alias("file"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("file", F.lit("page read twice").alias("kind"))
    return single.unionByName(repeated)


def parse_pages(
    call_set_pages: DataFrame, variant_pages: DataFrame, matrix_pages: DataFrame, crop: Crop = SOYBEAN, marker_map: DataFrame | None = None
) -> VariantSet:
    # written: every call meets both lists, and their sizes decide how
    sets, listed = land(call_sets(call_set_pages), "call-sets"), land(variants(variant_pages, crop, marker_map), "variants")
    rows = matrix_rows(matrix_pages).join(listed.select(F.col("variant_db_id").alias("v"), "marker_id", F.size("alleles").alias("n_alleles")), "v", "left")
    known = row_cells(rows, "marker_id", "n_alleles").join(sets.select("call_set_db_id", "sample_id"), "call_set_db_id", "left")
    known = computed_once(known, [c for c in known.columns if c not in ("phased", "unphased")], parts=linked_parts(F.col("token"), F.col("phased"), F.col("unphased")))
    call = linked_call_of(F.col("token"), F.col("parts"), F.col("unknown"))
    # a variant without listed bases has no allele count to exceed (size of NULL is -1 or NULL)
    beyond = (F.col("n_alleles") > 0) & (F.greatest("call.a1", "call.a2") >= F.col("n_alleles"))
    judged = computed_once(known, known.columns, call=call).withColumn(
        "kind",
        F.when(F.col("marker_id").isNull(), "variant not in the variant list").when(F.col("sample_id").isNull(), "call set not in the call set list")
        .when(F.col("call.problem").isNotNull(), F.col("call.problem")).when(beyond, "allele index beyond the variant's alleles"),
    )
    shared_ids = duplicates(sets, "sample_id").select(F.lit("").alias("file"), F.lit("sample id not unique").alias("kind"), F.col("sample_id").alias("detail"))
    violations = (
        page_problems(matrix_pages).withColumn("detail", F.lit(""))
        .unionByName(listed.filter("problem is not null").select("file", F.col("problem").alias("kind"), F.col("marker_id").alias("detail")))
        .unionByName(judged.filter("kind is not null").select("file", "kind", F.concat_ws(" ", "variant_db_id", "call_set_db_id", "token").alias("detail")))
        .unionByName(shared_ids).withColumn("ord", F.lit(0))
    )
    good = judged.filter("kind is null")
    top = good.groupBy("marker_id").agg(F.max(F.greatest("call.a1", "call.a2")).alias("top"))
    numbers = F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce("top", F.lit(0)), F.lit(0))), lambda i: i.cast("string"))
    markers = listed.filter("problem is null").join(top, "marker_id", "left").select(
        "marker_id", "chrom", "pos_bp", F.lit(None).cast("double").alias("cm"), "file_ord", F.coalesce("alleles", numbers).alias("alleles")
    )
    warnings = _warnings(sets, listed, carried_marks(matrix_pages))
    return VariantSet(markers, good.select("marker_id", "sample_id", "call.a1", "call.a2"), sets.select(*CALL_SET_COLUMNS), violations, warnings)


def carried_ids(pages: DataFrame) -> DataFrame:
    """(key, id): the ids that matrix pages carry a cell of, once each."""
    return carried_marks(pages).distinct()


def carried_marks(pages: DataFrame) -> DataFrame:
    """(key, id) per page and id that it carries a cell of: from the ids of the pages, not from their cells."""
    def marked(ids: str, key: str) -> Column:
        return F.transform(ids, lambda x: F.struct(F.lit(key).alias("key"), x.alias("id")))

    return _shaped(pages, filled=True).select(F.inline(F.concat(marked("v", "variant_db_id"), marked("c", "call_set_db_id"))))


def _warnings(sets: DataFrame, listed: DataFrame, carried: DataFrame) -> DataFrame:
    names = sets.filter("n_sharing > 1 and call_set_name <> ''").groupBy("call_set_name").agg(F.count(F.lit(1)).alias("n"))
    return (
        names.select(F.lit("shared call set name").alias("kind"), F.col("call_set_name").alias("subject"))
        .unionByName(absent(carried, variant_db_id=(listed, "variant absent from every page"), call_set_db_id=(sets, "call set absent from every page")))
    )


def absent(carried: DataFrame, **lists: tuple[DataFrame, str]) -> DataFrame:
    """(kind, subject) of listed ids that no matrix page carries: all their calls are missing. Given per key are its list and the
    name of the kind; ids of all keys meet in one aggregate, so that the pages are read once."""
    ids = carried.select("key", "id", F.lit(0).alias("n"), F.lit(True).alias("carried"))
    for key, (listed, _) in lists.items():
        ids = ids.unionByName(listed.select(F.lit(key).alias("key"), F.col(key).alias("id"), F.lit(1).alias("n"), F.lit(False).alias("carried")))
    silent = ids.groupBy("key", "id").agg(F.sum("n").cast("int").alias("n"), F.bool_or("carried").alias("carried")).filter("n > 0 and not carried")
    kind = F.create_map(*[F.lit(x) for key, (_, kind) in lists.items() for x in (key, kind)])[F.col("key")]
    return silent.select(kind.alias("kind"), F.explode(F.array_repeat("id", F.col("n"))).alias("subject"))
