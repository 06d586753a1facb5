"""Loci: resolution to markers, and the three-valued status of every sample at every locus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from introspark.config import REGION, Locus
from introspark.functions.chrom import SOYBEAN, Crop, canonical_chrom
from introspark.operators.classify import is_counted

_LOCUS_SCHEMA = (
    "locus_id string, section string, ord int, kind string, marker_id string, chrom string, start_bp bigint, end_bp bigint, "
    "left_marker string, right_marker string, rule string, min_markers int, satisfying array<int>, min_run int, "
    "anchor_bp bigint, tolerate_isolated boolean, flank_left double, flank_right double"
)


def locus_table(spark: SparkSession, loci: Sequence[Locus], crop: Crop = SOYBEAN) -> DataFrame:
    """The criteria's loci as a table: one row per locus, so its size is the size of the criteria document."""
    rows = [
        (
            x.locus_id, x.section, i, x.kind, x.marker_id, x.chrom, x.start_bp, x.end_bp, x.left_marker, x.right_marker,
            *x.effective_rule, list(x.satisfying), x.min_run, x.anchor_bp, x.tolerate_isolated,
            *[None if f is None else float(f) for f in (x.flank_left, x.flank_right)],
        )
        for i, x in enumerate(loci)
    ]
    return spark.createDataFrame(rows, _LOCUS_SCHEMA).withColumn("chrom", canonical_chrom(F.col("chrom"), crop))


def region_columns(shorthand: Column) -> Column:
    """STRUCT(chrom, start_bp, end_bp) from ``Chr:1,000-2,000``."""
    pattern = REGION.pattern

    def number(group: int) -> Column:
        return F.replace(F.regexp_extract(shorthand, pattern, group), F.lit(",")).try_cast("bigint")

    return F.struct(
        F.nullif(F.regexp_extract(shorthand, pattern, 1), F.lit("")).alias("chrom"), number(2).alias("start_bp"), number(3).alias("end_bp")
    )


def locus_members(markers: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, marker_id, chrom, pos_bp, file_ord): the markers that decide each locus.

    The locus table is broadcast: it holds one row per locus of the criteria document.
    """
    keep = ["locus_id", "marker_id", "chrom", "pos_bp", "file_ord"]
    named = loci.select("locus_id", F.explode(F.array_compact(F.array("marker_id", "left_marker", "right_marker"))).alias("marker_id"))
    by_id = markers.join(F.broadcast(named), "marker_id").select(*keep)
    regions = loci.filter("kind = 'region'").select("locus_id", F.col("chrom").alias("_chrom"), "start_bp", "end_bp")
    by_position = markers.join(
        F.broadcast(regions), (F.col("chrom") == F.col("_chrom")) & F.col("pos_bp").between(F.col("start_bp"), F.col("end_bp"))
    ).select(*keep)
    return by_id.unionByName(by_position)


def resolved_loci(loci: DataFrame, members: DataFrame) -> DataFrame:
    """Loci with chromosome, bounds, member count and a ``problem`` when they cannot be resolved."""
    found = members.groupBy("locus_id").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("chrom").alias("_c1"), F.max("chrom").alias("_c2"),
        F.min("pos_bp").alias("_p1"), F.max("pos_bp").alias("_p2"),
    )
    region = F.col("kind") == "region"
    needed = F.when(F.col("kind") == "flanking", 2).otherwise(1)
    problem = (
        F.when(region & F.col("n_members").isNull(), "no markers in the region")
        .when(~region & (F.coalesce("n_members", F.lit(0)) < needed), "marker not in the genotype file")
        .when((F.col("kind") == "flanking") & (F.col("_c1") != F.col("_c2")), "flanking markers on different chromosomes")
    )
    start, end = F.when(region, F.col("start_bp")).otherwise(F.col("_p1")), F.when(region, F.col("end_bp")).otherwise(F.col("_p2"))
    return (
        loci.join(found, "locus_id", "left")
        .withColumn("problem", problem)
        .withColumn("chrom", F.when(region, F.col("chrom")).otherwise(F.col("_c1")))
        .withColumn("start_bp", start)
        .withColumn("end_bp", end)
        .withColumn("anchor_bp", F.coalesce("anchor_bp", F.expr("(start_bp + end_bp) div 2")))
        .drop("_c1", "_c2", "_p1", "_p2")
    )


def every_sample_at_every_locus(samples: DataFrame, loci: Sequence[Locus]) -> DataFrame:
    """(sample_id, locus_id) from the literal ids of the criteria; no join."""
    return samples.select("sample_id", F.explode(F.array(*[F.lit(x.locus_id) for x in loci])).alias("locus_id"))


def with_spots(markers: DataFrame, members: DataFrame, flanks: DataFrame | None = None) -> DataFrame:
    """Markers with ``spots``: the loci they decide (side ``member``) or flank (``left``, ``right``), with their step.

    Null where a marker concerns no locus; else about one spot per locus of the criteria that it concerns. The spots ride
    on the marker's calls through the one join of calls with markers, so that no later step joins calls by marker again.
    """
    step = F.struct(F.lit(0.0).alias("distance"), "pos_bp", "file_ord")
    spots = members.select("marker_id", F.struct("locus_id", F.lit("member").alias("side"), step.alias("step")).alias("spot"))
    if flanks is not None:
        spots = spots.unionByName(flanks.select("marker_id", F.struct("locus_id", "side", "step").alias("spot")))
    return markers.join(spots.groupBy("marker_id").agg(F.collect_list("spot").alias("spots")), "marker_id", "left")


def locus_calls(state_rows: DataFrame) -> DataFrame:
    """(sample_id, state, locus_id, side, step): counted calls at the spots of their markers."""
    return state_rows.filter(F.col("spots").isNotNull() & is_counted(F.col("state"))).select("sample_id", "state", F.inline("spots"))


def member_rows(near: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counted calls at locus members (of ``locus_calls``), with whether they satisfy their locus."""
    rules = resolved.select("locus_id", "rule", "satisfying", "anchor_bp", "tolerate_isolated")
    return (
        near.filter("side = 'member'").select("sample_id", "state", "locus_id", "step.pos_bp", "step.file_ord")
        .join(F.broadcast(rules), "locus_id")  # one row per locus
        .withColumn("satisfied", F.array_contains("satisfying", F.col("state").cast("int")))
    )


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_counted"), F.count_if(F.col("satisfied")).alias("n_satisfied")]


def member_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id", "locus_id").agg(*_counts())


def member_runs(rows: DataFrame) -> DataFrame:
    """Counts and the length of the joined run through the anchor, per sample and run locus.

    A row is joined when it satisfies the locus, or is the only exception between two that do. The
    run is whatever lies strictly between the nearest unjoined rows on both sides of the anchor span.
    A group is one sample's called markers inside one region of the criteria.
    """
    ordered = Window.partitionBy("sample_id", "locus_id").orderBy("pos_bp", "file_ord")
    whole = Window.partitionBy("sample_id", "locus_id")
    k, a, b, sat = F.col("k"), F.col("a"), F.col("b"), F.col("satisfied")
    bridged = F.coalesce(F.col("tolerate_isolated") & F.lag("satisfied").over(ordered) & F.lead("satisfied").over(ordered), F.lit(False))
    key = F.struct("pos_bp", "file_ord")
    spanned = rows.filter("rule = 'run'").select(
        "sample_id", "locus_id", "satisfied", key.alias("k"), (sat | bridged).alias("joined"),
        F.max(F.when(F.col("pos_bp") <= F.col("anchor_bp"), key)).over(whole).alias("a"),
        F.min(F.when(F.col("pos_bp") >= F.col("anchor_bp"), key)).over(whole).alias("b"),
    )
    # several calls on the anchor itself all belong to the span
    fenced = spanned.select(
        "*",
        F.max(F.when(~F.col("joined") & (k < F.least(a, b)), k)).over(whole).alias("left_fence"),
        F.min(F.when(~F.col("joined") & (k > F.greatest(a, b)), k)).over(whole).alias("right_fence"),
    )
    in_run = (F.col("left_fence").isNull() | (k > F.col("left_fence"))) & (F.col("right_fence").isNull() | (k < F.col("right_fence")))
    in_span = (k >= F.least(a, b)) & (k <= F.greatest(a, b))
    return fenced.groupBy("sample_id", "locus_id").agg(
        *_counts(), F.every(a.isNotNull() & b.isNotNull() & (~in_span | F.col("joined"))).alias("span_joined"),
        F.count_if(sat & in_run).alias("run_length"),
    )


def status_column() -> Column:
    """pass / fail / unknown from the counts and, for run loci, the run."""
    n, ok = F.coalesce("n_counted", F.lit(0)), F.coalesce("n_satisfied", F.lit(0))
    passes = (
        F.when(F.col("rule") == "all", ok == n).when(F.col("rule") == "any", ok >= 1)
        .otherwise(F.col("span_joined") & (F.col("run_length") >= F.col("min_run")))
    )
    return F.when(n < F.col("min_markers"), "unknown").when(F.coalesce(passes, F.lit(False)), "pass").otherwise("fail")


def locus_status(near: DataFrame, samples: DataFrame, loci: Sequence[Locus], resolved: DataFrame) -> DataFrame:
    """(sample_id, locus_id, section, ord, status, n_counted, n_satisfied) for every sample and locus.

    ``near`` are ``locus_calls``. Only run loci shuffle their calls; the others are counted before the shuffle.
    """
    rows = member_rows(near, resolved)
    rules = resolved.select("locus_id", "section", "ord", "rule", "min_markers", "min_run")
    out = (
        every_sample_at_every_locus(samples, loci)
        .join(F.broadcast(rules), "locus_id")  # one row per locus
    )
    judged = member_counts(rows.filter("rule <> 'run'")).withColumns({"span_joined": F.lit(None).cast("boolean"), "run_length": F.lit(None).cast("bigint")})
    if any(x.effective_rule[0] == "run" for x in loci):
        judged = judged.unionByName(member_runs(rows))
    return out.join(judged, ["sample_id", "locus_id"], "left").select(
        "sample_id", "locus_id", "section", "ord", status_column().alias("status"),
        F.coalesce("n_counted", F.lit(0)).alias("n_counted"), F.coalesce("n_satisfied", F.lit(0)).alias("n_satisfied"),
    )


def all_pass_columns() -> list[Column]:
    """Aggregates over one sample's loci: do all targets pass, do all avoid loci pass."""
    passed = F.col("status") == "pass"
    return [
        F.coalesce(F.every(F.when(F.col("section") == section, passed)), F.lit(True)).alias(name)
        for section, name in (("target", "foreground_all_pass"), ("avoid", "avoid_all_pass"))
    ]
