"""The ranking job: dataset and criteria in, one result row per progeny out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark import __version__
from introspark.config import Criteria, resolved_assembly
from introspark.operators import background, classify, drag, loci, qc, rank, similarity
from introspark.operators.common import land, land_counted, pinned
from introspark.operators.dataset import Dataset, has_cm, keep_manifest
from introspark.plans.assemble import WARNINGS, require_clean, warning_rows
from introspark.schema import (
    DEFAULT_COVERAGE,
    RESULT_LAST,
    RESULT_PREFIX,
    RESULTS_SCHEMA,
    TOOL_NAME,
)

MARKER_COLUMNS = (
    "marker_id", "chrom", "pos_bp", "cm", "file_ord", "rp1", "rp2", "dp1", "dp2", "informative", "reason", "weight2",
)
#: What a written call keeps of its marker.
STATE_COLUMNS = ("chrom", "rp1", "rp2", "dp1", "dp2", "weight2")


class DataContractError(ValueError):
    """A run that its data can't support."""


@dataclass
class Analysis:
    """The tables of one run."""

    dataset: Dataset
    criteria: Criteria
    assembly: str
    background_unit: str
    flank_unit: str
    markers: DataFrame
    ends: DataFrame
    states: DataFrame
    members: DataFrame
    resolved: DataFrame
    status: DataFrame
    drag: DataFrame
    metrics: DataFrame
    progeny: DataFrame
    notes: list[tuple[str, str, float | None]] = field(default_factory=list)  # kind, subject, value: decided on the driver
    n_progeny: int = 0
    n_pool: int = 0
    pair_options: dict = field(default_factory=dict)
    pairs: DataFrame | None = None


def _unit(requested: str, map_complete: bool) -> str:
    return "cm" if requested in ("auto", "cm") and map_complete else "bp"


def analyse(dataset: Dataset, criteria: Criteria, **pair_options) -> Analysis:
    """Lay out the whole analysis.

    Tables that several branches read are written: the markers, the progeny's calls with their states and what later
    steps need of their markers, and the per-sample metrics. Counts are observed as they are written. Everything after them is lazy. ``pair_options`` go to the
    duplicate scan. A dataset whose assembly found violations is refused.
    """
    spark = require_clean(dataset).markers.sparkSession
    assembly = resolved_assembly(criteria, dataset.crop)
    asks_for_cm = criteria.flank_unit == "cm" or criteria.background.map_unit != "bp"
    complete = bool(has_cm(dataset.markers).first()["has_cm"]) if asks_for_cm else False
    background_unit, flank_unit = _unit(criteria.background.map_unit, complete), _unit(criteria.flank_unit, complete)
    notes = []
    if criteria.background.map_unit == "cm" and background_unit == "bp":
        notes.append(("unit falls back to bp, since the map lacks cM", "background", None))
    if criteria.flank_unit == "cm" and flank_unit == "bp":
        notes.append(("unit falls back to bp, since the map lacks cM", "flank", None))

    classified = classify.classified_markers(dataset)
    if criteria.background.model == "weighted":
        source_ends = background.chromosome_ends(dataset.markers, assembly, dataset.crop)
        weighed = background.marker_weights(classified, source_ends, background_unit, criteria.background.max_marker_coverage)
        if background_unit == "bp" and criteria.background.map_unit != "bp":
            cap = criteria.background.max_marker_coverage or DEFAULT_COVERAGE["bp"]
            notes.append(("a marker stands for at most so many bp", "background", float(cap)))
    else:
        weighed = background.unit_weights(classified)
    # the marker table feeds every later step: computed once
    markers, counted = land_counted(weighed.select(*MARKER_COLUMNS), "markers", n=F.count(F.lit(1)), n_pool=F.count_if("informative"))
    ends = background.chromosome_ends(markers, assembly, dataset.crop)

    table = loci.locus_table(spark, criteria.loci, dataset.crop)
    members = loci.locus_members(markers, table)
    resolved = pinned(drag.locus_edges(markers, loci.resolved_loci(table, members), ends, flank_unit))
    flanks = drag.flank_markers(markers, members, resolved, flank_unit)

    progeny, people = land_counted(dataset.progeny, "progeny", n=F.count(F.lit(1)))
    # the only join of calls with markers: everything later reads the written states
    fact = classify.states(keep_manifest(dataset.calls, progeny), loci.with_spots(markers, members, flanks))
    fact = land(fact.select("sample_id", "marker_id", "a1", "a2", "state", *STATE_COLUMNS, "spots"), "states")
    near = loci.locus_calls(fact)
    status = loci.locus_status(near, progeny, criteria.loci, resolved)
    bounds = drag.drag_bounds(near, progeny, criteria.targets, resolved, criteria)

    carrier = resolved.filter("section = 'target'").select("chrom").distinct()
    metrics = qc.sample_metrics(qc.metrics_by_chromosome(fact), progeny, F.lit(counted["n"]), carrier)
    return Analysis(
        dataset, criteria, assembly, background_unit, flank_unit, markers, ends, fact, members, resolved, status, bounds,
        land(metrics, "sample_metrics"), progeny, notes, people["n"], counted["n_pool"], pair_options,
    )


def duplicate_pairs(run: Analysis) -> DataFrame:
    """The duplicate scan over all informative markers and all progeny, written once; ``run.pair_options`` are the
    arguments of ``similarity.duplicate_scan``."""
    if run.pairs is None:
        pool = run.markers.filter("informative").select("marker_id")
        progeny = run.progeny
        if "sample_ord" not in progeny.columns:
            progeny = progeny.withColumn("sample_ord", F.col("sample_id"))
        found = similarity.duplicate_scan(run.states, pool, progeny, run.n_pool, run.n_progeny, **run.pair_options)
        run.pairs = land(found, "sample_pairs")
    return run.pairs


def run_warnings(run: Analysis) -> DataFrame:
    """All that the run warns of, from its assembly to its pairs, in one table: part, kind, subject, value."""
    none = F.lit(None).cast("string")
    parents = qc.parent_qc(run.dataset.parent_calls(), run.markers, run.criteria.filters)
    ends, siblings = background.end_warnings(run.ends), qc.sibling_caveat(run.progeny)
    skipped = similarity.skipped_pairs(duplicate_pairs(run), run.n_progeny).filter("n_skipped > 0")
    parts = [
        run.markers.sparkSession.createDataFrame([("units", *note) for note in run.notes], WARNINGS),
        warning_rows(parents, "parents", F.col("kind"), F.coalesce("sample_id", none), F.col("value")),
        warning_rows(ends, "chromosomes", F.col("kind"), F.col("chrom"), F.col("last_bp")),
        warning_rows(siblings, "pairs", F.lit("siblings are as alike as duplicates"), none, F.col("sibling_ibs")),
        warning_rows(skipped, "pairs", F.lit("too few common calls to compare"), none, F.col("n_skipped")),
    ]
    out = parts[0] if run.dataset.warnings is None else parts[0].unionByName(run.dataset.warnings)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validation_summary(run: Analysis) -> DataFrame:
    """One row of counts of the run, its warnings included."""
    n_pairs = duplicate_pairs(run).agg(F.count("sample_a").alias("n")).scalar()
    n_warnings = run_warnings(run).agg(F.count(F.lit(1)).alias("n")).scalar()
    return qc.validation_summary(run.markers, run.dataset.samples, flagged_samples(run), n_pairs, n_warnings)


def require_resolved(run: Analysis) -> None:
    """Refuse loci that match nothing."""
    bad = run.resolved.filter("problem is not null").orderBy("ord").select("locus_id", "problem").collect()
    if bad:
        raise DataContractError(f"locus {bad[0]['locus_id']}: {bad[0]['problem']}")


def is_reserved(chrom: Column) -> Column:
    """Whether the results column of a chromosome would overwrite a fixed one."""
    return F.concat(F.lit("rpp_"), chrom).isin(*RESULT_PREFIX)


def require_free_names(chroms: DataFrame) -> None:
    """Refuse chromosome names that would overwrite fixed result columns; ``chroms`` has one row per chromosome."""
    bad = chroms.filter(is_reserved(F.col("chrom"))).agg(F.min("chrom").alias("chrom")).first()["chrom"]
    if bad is not None:
        raise DataContractError(f"chromosome {bad!r}: its results column collides with a fixed column")


def locus_summary(run: Analysis) -> DataFrame:
    """One row per sample: reasons, all-pass flags, drag totals and components, and the columns of every locus."""
    targets = [x.locus_id for x in run.criteria.targets]
    avoid = [x.locus_id for x in run.criteria.avoid]

    def at(locus: str, value: str, name: str) -> Column:
        return F.max(F.when(F.col("locus_id") == locus, F.col(value))).alias(name)

    pieces = (("status", "target_{}_status"), ("left_max", "drag_{}_left_max"), ("right_max", "drag_{}_right_max"),
              ("recombinant_left", "recomb_{}_left"), ("recombinant_right", "recomb_{}_right"))
    aggregates, columns = drag.drag_columns(len(targets))
    outcomes = run.status.join(run.drag.drop("ord"), ["sample_id", "locus_id"], "left")
    per_sample = outcomes.groupBy("sample_id").agg(
        rank.reasons_column(run.criteria.filters), *loci.all_pass_columns(), *aggregates,
        *[at(t, value, name.format(t)) for t in targets for value, name in pieces],
        *[at(a, "status", f"avoid_{a}_status") for a in avoid],
    )
    return per_sample.select(*[F.col(f"`{c}`") for c in per_sample.columns if c not in ("_t", "recombinant_flanks")], *columns)


def outliers(run: Analysis) -> DataFrame:
    return qc.family_outliers(qc.donor_shares(run.metrics, run.criteria.filters))


def flagged_samples(run: Analysis) -> DataFrame:
    return qc.with_flags(run.metrics, run.criteria.filters, outliers(run), similarity.duplicate_members(duplicate_pairs(run)))


def scored_samples(run: Analysis) -> DataFrame:
    """Metrics, flags, filters, components, score and locus columns: one lazy row per progeny."""
    joined = flagged_samples(run).join(locus_summary(run), "sample_id")
    return rank.hard_filters(joined, run.criteria.filters).withColumn("composite_score", rank.composite_score(run.criteria.weights))


def ranked_samples(run: Analysis) -> DataFrame:
    """Scored samples with ranks. The scored table is pinned first: ranking reads it more than once."""
    return rank.ranks(land(scored_samples(run), "scored"), run.criteria.rank_mode)


def result_columns(run: Analysis, chroms: list[str]) -> list[str]:
    per_target = ("target_{}_status", "drag_{}_left_max", "drag_{}_right_max", "recomb_{}_left", "recomb_{}_right")
    dynamic = [p.format(t.locus_id) for t in run.criteria.targets for p in per_target]
    dynamic += [f"avoid_{a.locus_id}_status" for a in run.criteria.avoid]
    return [*RESULT_PREFIX, *dynamic, *[f"rpp_{c}" for c in chroms], RESULT_LAST]


def results(run: Analysis, chroms: list[str] | None = None) -> DataFrame:
    """The results table, in contract column order. Sort by ``rank.result_order()`` when writing.

    ``chroms`` names the per-chromosome columns; by default the chromosomes of the data are listed first
    (one row per chromosome).
    """
    from introspark.functions.chrom import chrom_order

    require_resolved(run)
    if chroms is None:
        listed = run.ends.orderBy(chrom_order(F.col("chrom"), run.dataset.crop)).select("chrom").collect()
        chroms = [r["chrom"] for r in listed]
    require_free_names(run.ends)
    weighted = run.criteria.background.model == "weighted"
    cap = run.criteria.background.max_marker_coverage
    coverage = float(DEFAULT_COVERAGE[run.background_unit] if cap is None else cap) if weighted else None
    empty = F.lit("")
    ranked = ranked_samples(run)
    if run.dataset.call_sets is not None:
        refs = run.dataset.call_sets.select("sample_id", "call_set_db_id", "sample_db_id")
        ranked = ranked.join(refs, "sample_id", "left")
    else:
        ranked = ranked.withColumns({"call_set_db_id": empty, "sample_db_id": empty})
    fixed = {
        "qc_flags": F.array_join("flags", "|"),
        "drag_unit": F.lit(run.flank_unit),
        "background_model": F.lit(run.criteria.background.model),
        "background_unit": F.lit(run.background_unit),
        "rank_mode": F.lit(run.criteria.rank_mode),
        "assembly": F.lit(run.assembly),
        "results_schema": F.lit(RESULTS_SCHEMA),
        "crop": F.lit(run.dataset.crop.crop_id),
        "call_set_db_id": F.coalesce("call_set_db_id", empty),
        "sample_db_id": F.coalesce("sample_db_id", empty),
        "background_max_marker_coverage": F.lit(coverage).cast("double"),
        "tool": F.lit(TOOL_NAME),
        "tool_version": F.lit(__version__),
        "tool_commit": F.lit(None).cast("string"),
        "token_profile": F.lit(run.dataset.token_profile),
        **{f"rpp_{c}": F.try_element_at("rpp_chrom", F.lit(c)) for c in chroms},
    }
    return ranked.withColumns(fixed).select(*[F.col(f"`{c}`") for c in result_columns(run, chroms)])
