"""Registered queries: (name) -> (DataFrame builder, SQL or None). Names start with the inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.generation import expected_fractions, expected_rpp, parse_generation
from introspark.operators import background, classify, drag, loci, maps, navigation, qc, rank, select, similarity, strips
from introspark.operators.common import land, pinned
from introspark.operators.dataset import has_cm, ordered_markers
from introspark.plans import rank as ranking
from workload import binding
from workload.oracle import sql

# The bound calls are sparse, so pairs are compared from a thousandth of the pool on.
OVERLAP = 0.001

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, None if oracle is None else sql(oracle))
        return fn

    return add


def _run(spark: SparkSession, sf: str, **changes) -> ranking.Analysis:
    data = binding.dataset(spark, sf)
    # the bound calls come out of an aggregate over lineitem and are read three times
    return ranking.analyse(data, binding.criteria(**changes), min_overlap=OVERLAP)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-sample metrics as one lazy plan."""
    fact, markers = _fact(spark, sf)
    carrier = loci.locus_members(markers, loci.locus_table(spark, binding.criteria().targets)).select("chrom").distinct()
    n_markers = markers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return qc.sample_metrics(qc.metrics_by_chromosome(fact), binding.dataset(spark, sf).progeny, n_markers, carrier)


def _fact(spark: SparkSession, sf: str, unit: str = "bp") -> tuple[DataFrame, DataFrame]:
    """(states of all progeny calls, weighed markers), without the rest of the analysis."""
    data = binding.dataset(spark, sf)
    markers = classify.classified_markers(data)
    ends = background.chromosome_ends(data.markers, "Wm82.a4", data.crop)
    weighed = background.marker_weights(markers, ends, unit)
    return classify.states(binding.progeny_calls(spark, sf), weighed), weighed


# --- flagship ---------------------------------------------------------------------------------------------

RANK_COLUMNS = (
    "sample_id, family_id, rank_overall, rank_in_family, passes_filters, exclusion_reason, composite_score, rpp_total, rpp_carrier, "
    "rpp_noncarrier, drag_total_est, missing_rate, foreground_all_pass, avoid_all_pass"
)


@register("rank_backcross_progeny", f"SELECT {RANK_COLUMNS} FROM ranked")
def rank_backcross_progeny(spark, sf):
    ranked = ranking.ranked_samples(_run(spark, sf))
    return ranked.select(*[c.strip() for c in RANK_COLUMNS.split(",")]).orderBy(*rank.result_order())


# --- classification -----------------------------------------------------------------------------------------


@register("j3_classify", """SELECT marker_id, sample_id, substr('AHBXNU', state + 1, 1) AS label FROM states""")
def j3_classify(spark, sf):
    fact = classify.states(binding.progeny_calls(spark, sf), classify.classified_markers(binding.dataset(spark, sf)))
    return fact.select("marker_id", "sample_id", classify.state_label(F.col("state")).alias("label"))


@register("j3_informative_markers", "SELECT marker_id, chrom, pos_bp, informative, coalesce(reason, '') AS reason FROM classified")
def j3_informative_markers(spark, sf):
    return classify.classified_markers(binding.dataset(spark, sf)).select(
        "marker_id", "chrom", "pos_bp", "informative", F.coalesce("reason", F.lit("")).alias("reason")
    )


@register("a12_uninformative_summary",
          "SELECT reason, count(*) AS n_markers FROM classified WHERE reason IS NOT NULL GROUP BY reason ORDER BY 2 DESC, 1")
def a12_uninformative_summary(spark, sf):
    return classify.uninformative_summary(classify.classified_markers(binding.dataset(spark, sf)))


# --- background ---------------------------------------------------------------------------------------------


@register("w1_marker_weights_bp", "SELECT c.marker_id, CAST(coalesce(w2, 0) AS DOUBLE) / 2 AS weight FROM classified c LEFT JOIN weights_bp USING (marker_id)")
def w1_marker_weights_bp(spark, sf):
    return _fact(spark, sf)[1].select("marker_id", (F.col("weight2") / 2).alias("weight"))


@register("w1_marker_weights_cm", "SELECT c.marker_id, round(CAST(coalesce(w2, 0) AS DOUBLE) / 2, 6) AS weight FROM classified c LEFT JOIN weights_cm USING (marker_id)")
def w1_marker_weights_cm(spark, sf):
    return _fact(spark, sf, "cm")[1].select("marker_id", F.round(F.col("weight2") / 2, 6).alias("weight"))


@register("a1_rpp_weighted", "SELECT sample_id, sum(w2 * (2 - state)) / nullif(sum(2 * w2), 0) AS rpp_total FROM states WHERE state <= 2 GROUP BY sample_id")
def a1_rpp_weighted(spark, sf):
    fact, _ = _fact(spark, sf)
    return fact.filter("state <= 2").groupBy("sample_id").agg(*background.rpp_sums()).select(
        "sample_id", background.ratio(F.col("rpp_num"), F.col("rpp_den")).alias("rpp_total")
    )


@register("a1_rpp_weighted_cm", """
    SELECT sample_id, round(sum(w.w2 * (2 - state)) / nullif(sum(2 * w.w2), 0), 6) AS rpp_total
    FROM states JOIN weights_cm w USING (marker_id) WHERE state <= 2 GROUP BY sample_id""")
def a1_rpp_weighted_cm(spark, sf):
    fact, _ = _fact(spark, sf, "cm")
    return fact.filter("state <= 2").groupBy("sample_id").agg(*background.rpp_sums()).select(
        "sample_id", F.round(background.ratio(F.col("rpp_num"), F.col("rpp_den")), 6).alias("rpp_total")
    )


@register("a1_rpp_count_model", "SELECT sample_id, sum(2 - state) / (2 * count(*)) AS rpp_total FROM states WHERE state <= 2 GROUP BY sample_id")
def a1_rpp_count_model(spark, sf):
    markers = background.unit_weights(classify.classified_markers(binding.dataset(spark, sf)))
    fact = classify.states(binding.progeny_calls(spark, sf), markers).filter("state <= 2")
    return fact.groupBy("sample_id").agg(*background.rpp_sums()).select(
        "sample_id", background.ratio(F.col("rpp_num"), F.col("rpp_den")).alias("rpp_total")
    )


@register("a2_rpp_by_chromosome", """
    SELECT sample_id, chrom, sum(w2 * (2 - state)) FILTER (state <= 2) / nullif(sum(2 * w2) FILTER (state <= 2), 0) AS rpp
    FROM states GROUP BY sample_id, chrom""")
def a2_rpp_by_chromosome(spark, sf):
    return background.rpp_by_chromosome(_fact(spark, sf)[0])


@register("a3_rpp_carrier_split", "SELECT sample_id, rpp_carrier, rpp_noncarrier FROM metrics")
def a3_rpp_carrier_split(spark, sf):
    return _metrics(spark, sf).select("sample_id", "rpp_carrier", "rpp_noncarrier")


@register("a4_informative_called", "SELECT sample_id, n_informative_called FROM metrics")
def a4_informative_called(spark, sf):
    return _metrics(spark, sf).select("sample_id", "n_informative_called")


@register("a5_state_fractions", "SELECT sample_id, frac_a, frac_h, frac_b FROM metrics")
def a5_state_fractions(spark, sf):
    return _metrics(spark, sf).select("sample_id", "frac_a", "frac_h", "frac_b")


# --- loci -----------------------------------------------------------------------------------------------------


def _status(spark, sf):
    data = binding.dataset(spark, sf)
    markers = classify.classified_markers(data)
    _, members, resolved = _resolved(spark, sf)
    resolved = pinned(resolved)
    near = _near(spark, sf, loci.with_spots(markers, members))
    return loci.locus_status(near, data.progeny, binding.criteria().loci, resolved)


def _near(spark, sf, markers):
    """Calls near loci, written since several aggregates read them; only calls of markers with a spot are joined."""
    calls = classify.states(binding.progeny_calls(spark, sf), markers.filter("spots is not null"))
    return land(loci.locus_calls(calls), "locus_calls")


def _drag(spark, sf, **changes):
    """Drag bounds of the bound targets; the resolved loci (one row each) are pinned as literals."""
    data, criteria = binding.dataset(spark, sf), binding.criteria(**changes)
    _, members, resolved = _resolved(spark, sf)
    ends = background.chromosome_ends(data.markers, "Wm82.a4", data.crop)
    edges = pinned(drag.locus_edges(data.markers, resolved, ends, criteria.flank_unit))
    flanks = drag.flank_markers(data.markers, members, edges, criteria.flank_unit)
    near = _near(spark, sf, loci.with_spots(classify.classified_markers(data), members, flanks))
    return drag.drag_bounds(near, data.progeny, criteria.targets, edges, criteria)


def _resolved(spark, sf):
    data = binding.dataset(spark, sf)
    table = loci.locus_table(spark, binding.criteria().loci, data.crop)
    members = loci.locus_members(data.markers, table)
    return table, members, loci.resolved_loci(table, members)


@register("j6_locus_members", "SELECT locus_id, marker_id, pos_bp FROM members")
def j6_locus_members(spark, sf):
    return _resolved(spark, sf)[1].select("locus_id", "marker_id", "pos_bp")


@register("j4_resolved_loci", """
    SELECT locus_id, l.chrom, CAST(start_bp AS BIGINT) AS start_bp, CAST(end_bp AS BIGINT) AS end_bp, CAST(anchor_bp AS BIGINT) AS anchor_bp, count(*) AS n_members
    FROM loci l JOIN members USING (locus_id) GROUP BY ALL""")
def j4_resolved_loci(spark, sf):
    return _resolved(spark, sf)[2].select("locus_id", "chrom", "start_bp", "end_bp", "anchor_bp", "n_members")


@register("a10_locus_status", "SELECT sample_id, locus_id, section, status, n_counted, n_satisfied FROM status")
def a10_locus_status(spark, sf):
    return _status(spark, sf).select("sample_id", "locus_id", "section", "status", "n_counted", "n_satisfied")


@register("a10a_target_status", "SELECT sample_id, locus_id, status FROM status WHERE section = 'target'")
def a10a_target_status(spark, sf):
    return _status(spark, sf).filter("section = 'target'").select("sample_id", "locus_id", "status")


@register("a10b_avoid_status", "SELECT sample_id, locus_id, status FROM status WHERE section = 'avoid'")
def a10b_avoid_status(spark, sf):
    return _status(spark, sf).filter("section = 'avoid'").select("sample_id", "locus_id", "status")


@register("w4_run_rule", "SELECT sample_id, status FROM status WHERE locus_id = 'T2'")
def w4_run_rule(spark, sf):
    return _status(spark, sf).filter("locus_id = 'T2'").select("sample_id", "status")


@register("a25_all_pass", "SELECT sample_id, foreground_all_pass, avoid_all_pass FROM reasons")
def a25_all_pass(spark, sf):
    return _status(spark, sf).groupBy("sample_id").agg(*loci.all_pass_columns())


# --- drag -----------------------------------------------------------------------------------------------------


@register("a14_drag_bounds", """
    SELECT sample_id, locus_id, CAST(left_min AS DOUBLE) AS left_min, CAST(left_max AS DOUBLE) AS left_max, CAST(right_min AS DOUBLE) AS right_min,
           CAST(right_max AS DOUBLE) AS right_max, recombinant_left, recombinant_right, total_est FROM drag""")
def a14_drag_bounds(spark, sf):
    return _drag(spark, sf).select(
        "sample_id", "locus_id", "left_min", "left_max", "right_min", "right_max", "recombinant_left", "recombinant_right", "total_est"
    )


@register("a29_drag_component", "SELECT sample_id, drag_total_est, CAST(drag_total_max AS DOUBLE) AS drag_total_max, CAST(recombinant_flanks AS INT) AS recombinant_flanks, drag, recombinant FROM drag_sums")
def a29_drag_component(spark, sf):
    return drag.drag_summary(_drag(spark, sf), 3)


# --- quality control --------------------------------------------------------------------------------------------


@register("a6_missing_rate", "SELECT sample_id, missing_rate FROM metrics")
def a6_missing_rate(spark, sf):
    return _metrics(spark, sf).select("sample_id", "missing_rate")


@register("a7_call_rates", "SELECT sample_id, het_rate, hom_donor_rate, nonparental_rate FROM metrics")
def a7_call_rates(spark, sf):
    return _metrics(spark, sf).select("sample_id", "het_rate", "hom_donor_rate", "nonparental_rate")


@register("a8_ibs_to_parents", "SELECT sample_id, s_rp / nullif(2 * c_rp, 0) AS ibs_rp, s_dp / nullif(2 * c_dp, 0) AS ibs_donor FROM sums")
def a8_ibs_to_parents(spark, sf):
    return similarity.ibs_to_parents(binding.progeny_calls(spark, sf), classify.classified_markers(binding.dataset(spark, sf)))


def _scan(spark, sf, **options):
    data = binding.dataset(spark, sf)
    pool = classify.classified_markers(data).filter("informative").select("marker_id")
    sizes = pool.agg(F.count(F.lit(1)).alias("n_pool")).first()
    n_samples = data.progeny.count()
    return similarity.duplicate_scan(
        binding.progeny_calls(spark, sf), pool, data.progeny, sizes["n_pool"], n_samples, min_overlap=OVERLAP, **options
    ), n_samples


PAIR_FLOOR = "(SELECT n FROM pair_floor)"


@register("j10_pairwise_ibs", f"""
    SELECT sample_a, sample_b, n_shared / (2 * n_overlap) AS ibs, n_overlap FROM pairs
    WHERE n_overlap >= {PAIR_FLOOR} AND n_shared / (2 * n_overlap) >= 0.8""")
def j10_pairwise_ibs(spark, sf):
    pairs, _ = _scan(spark, sf, threshold=0.8)
    return pairs.filter("sample_a is not null").select("sample_a", "sample_b", "ibs", "n_overlap")


@register("a9_duplicate_pairs", f"""
    SELECT sample_a, sample_b, n_shared / (2 * n_overlap) AS ibs, n_overlap FROM pairs
    WHERE n_overlap >= {PAIR_FLOOR} AND n_shared / (2 * n_overlap) >= 0.995""")
def a9_duplicate_pairs(spark, sf):
    pairs, _ = _scan(spark, sf)
    return pairs.filter("sample_a is not null").select("sample_a", "sample_b", "ibs", "n_overlap")


@register("a9_skipped_pairs", f"""
    SELECT CAST((SELECT count(*) * (count(*) - 1) // 2 FROM progeny) - count(*) AS BIGINT) AS n_skipped FROM pairs WHERE n_overlap >= {PAIR_FLOOR}""")
def a9_skipped_pairs(spark, sf):
    return similarity.skipped_pairs(*_scan(spark, sf))


@register("a17_duplicate_members", f"""
    , d AS (SELECT sample_a, sample_b FROM pairs WHERE n_overlap >= {PAIR_FLOOR} AND n_shared / (2 * n_overlap) >= 0.995)
    SELECT sample_a AS sample_id FROM d UNION SELECT sample_b FROM d""")
def a17_duplicate_members(spark, sf):
    return similarity.duplicate_members(_scan(spark, sf)[0])


@register("a18_sibling_caveat", """
    SELECT CAST(max(n_bc) AS INT) AS n_backcross FROM (SELECT sample_id, n_bc + 4 AS n_bc FROM generations) HAVING max(n_bc) >= 6""")
def a18_sibling_caveat(spark, sf):
    advanced = binding.dataset(spark, sf).progeny.withColumn("generation", F.when(F.col("generation") == "BC2F1", "BC6F1").when(
        F.col("generation") == "BC3F1", "BC7F1").otherwise(F.col("generation")))
    return qc.sibling_caveat(advanced).select("n_backcross")


# --- generations --------------------------------------------------------------------------------------------------


@register("f1_generation_labels", "SELECT sample_id, coalesce(generation, '') AS generation, CAST(n_bc AS INT) AS n_backcross, CAST(n_filial AS INT) AS n_filial, known AS filial_known FROM generations")
def f1_generation_labels(spark, sf):
    g = parse_generation(F.col("generation"))
    return binding.dataset(spark, sf).progeny.select(
        "sample_id", F.coalesce("generation", F.lit("")).alias("generation"), g["n_backcross"].alias("n_backcross"),
        g["n_filial"].alias("n_filial"), g["filial_known"].alias("filial_known"),
    )


@register("f2_pedigree_labels", """
    SELECT s AS sample_id, CASE WHEN n >= 1 THEN n - 1 END AS n_backcross
    FROM (SELECT 's' || s_suppkey AS s, CAST(s_suppkey % 7 AS INT) AS n FROM supplier)""")
def f2_pedigree_labels(spark, sf):
    label = F.expr("case when s_suppkey % 4 = 0 then concat('RP*', s_suppkey % 7, '/D') when s_suppkey % 4 = 1 then concat(s_suppkey % 7, '*RP/D') "
                   "when s_suppkey % 4 = 2 then concat('D/RP*', s_suppkey % 7) else concat('D/', s_suppkey % 7, '*RP') end")
    return binding.table(spark, sf, "supplier").select(
        F.expr("concat('s', s_suppkey)").alias("sample_id"), parse_generation(label)["n_backcross"].alias("n_backcross")
    )


@register("f3_expected_fractions", """
    SELECT sample_id, het, (half - het) / 2 AS hom_donor, 1 - het - (half - het) / 2 AS hom_rp, 1 - het - (half - het) / 2 + het / 2 AS rpp, 1 - pow(0.5, n_bc + 1) AS rpp_backcross
    FROM (SELECT *, pow(0.5, n_bc) AS half, pow(0.5, n_bc) * pow(0.5, greatest(n_filial - 1, 0)) AS het FROM generations)""")
def f3_expected_fractions(spark, sf):
    g = parse_generation(F.col("generation"))
    parsed = binding.dataset(spark, sf).progeny.select("sample_id", g.alias("g"))
    return parsed.select("sample_id", expected_fractions(F.col("g")).alias("e"), expected_rpp(F.col("g")).alias("rpp_backcross")).select(
        "sample_id", "e.het", "e.hom_donor", "e.hom_rp", "e.rpp", "rpp_backcross"
    )


# --- flags, filters, ranks -----------------------------------------------------------------------------------------


def _flagged(spark, sf):
    metrics = land(_metrics(spark, sf), "metrics")
    filters = binding.criteria().filters
    return qc.with_flags(metrics, filters, qc.family_outliers(qc.donor_shares(metrics, filters)), similarity.duplicate_members(land(_scan(spark, sf)[0], "pairs")))


@register("a13_family_outliers", "SELECT sample_id FROM outliers")
def a13_family_outliers(spark, sf):
    return qc.family_outliers(qc.donor_shares(land(_metrics(spark, sf), "metrics"), binding.criteria().filters))


@register("a13_family_outliers_by_array", "SELECT sample_id FROM outliers")
def a13_family_outliers_by_array(spark, sf):
    return qc.small_family_outliers(qc.donor_shares(land(_metrics(spark, sf), "metrics"), binding.criteria().filters))


@register("f5_qc_flags", "SELECT sample_id, qc_flags FROM flagged")
def f5_qc_flags(spark, sf):
    return _flagged(spark, sf).select("sample_id", F.array_join("flags", "|").alias("qc_flags"))


@register("k10_qc_table", """
    SELECT sample_id, line_name, family_id, generation, missing_rate, het_rate, expected_het, hom_donor_rate, nonparental_rate, expected_rpp,
           ibs_rp, ibs_donor, qc_flags AS flags, excluding <> '' AS qc_excluded FROM flagged""")
def k10_qc_table(spark, sf):
    return qc.qc_table(_flagged(spark, sf), binding.criteria().filters)


@register("a11_parent_qc", """
    SELECT role, sample_id, n_het / nullif(n_called, 0) AS het_rate, 1.0 - n_called / (SELECT count(*) FROM part) AS missing_rate FROM (
        SELECT 'recurrent_parent' AS role, 's0' AS sample_id, count(*) FILTER (rp1 <> rp2) AS n_het, count(rp1) AS n_called FROM parents
        UNION ALL SELECT 'donor_parent', 's1', count(*) FILTER (dp1 <> dp2), count(dp1) FROM parents)""")
def a11_parent_qc(spark, sf):
    data = binding.dataset(spark, sf)
    parents = data.with_(calls=binding.parent_calls(spark, sf)).parent_calls()
    return qc.parent_rates(parents, data.markers).select("role", "sample_id", "het_rate", "missing_rate")


@register("a11_parent_warnings", """
    SELECT 'heterozygous parent' AS kind, role, sample_id, value FROM (
        SELECT 'recurrent_parent' AS role, 's0' AS sample_id, count(*) FILTER (rp1 <> rp2) / count(rp1) AS value FROM parents
        UNION ALL SELECT 'donor_parent', 's1', count(*) FILTER (dp1 <> dp2) / count(dp1) FROM parents) WHERE value > 0.01""")
def a11_parent_warnings(spark, sf):
    data = binding.dataset(spark, sf)
    markers = classify.classified_markers(data)
    parents = data.with_(calls=binding.parent_calls(spark, sf)).parent_calls()
    filters = binding.criteria(filters={"parent_max_het_rate": 0.01}).filters
    return qc.parent_qc(parents, markers, filters)


def _scored(spark, sf):
    return ranking.scored_samples(_run(spark, sf))


@register("a26_hard_filters", "SELECT sample_id, passes_filters, exclusion_reason FROM scored")
def a26_hard_filters(spark, sf):
    return _scored(spark, sf).select("sample_id", "passes_filters", "exclusion_reason")


@register("f4_composite_score", "SELECT sample_id, composite_score FROM scored")
def f4_composite_score(spark, sf):
    return _scored(spark, sf).select("sample_id", "composite_score")


@register("w2_weighted_rank", "SELECT sample_id, CAST(rank_overall AS INT) AS rank_overall, CAST(rank_in_family AS INT) AS rank_in_family FROM ranked")
def w2_weighted_rank(spark, sf):
    return ranking.ranked_samples(_run(spark, sf)).select("sample_id", "rank_overall", "rank_in_family")


@register("w2_weighted_rank_by_ranges", "SELECT sample_id, CAST(rank_overall AS INT) AS rank_overall, CAST(rank_in_family AS INT) AS rank_in_family FROM ranked")
def w2_weighted_rank_by_ranges(spark, sf):
    scored = land(_scored(spark, sf), "scored")
    return rank.ranks(scored, "weighted").select("sample_id", "rank_overall", "rank_in_family")


@register("w3_staged_rank", """
    SELECT s.sample_id, CAST(r AS INT) AS rank_overall, CAST(o.f AS INT) AS rank_in_family FROM scored s LEFT JOIN (
        SELECT sample_id, row_number() OVER (ORDER BY recombinant_flanks DESC NULLS LAST, rpp_carrier DESC NULLS LAST, rpp_noncarrier DESC NULLS LAST,
                                             drag_total_est NULLS LAST, missing_rate NULLS LAST, sample_id) AS r,
               row_number() OVER (PARTITION BY coalesce(family_id, '') ORDER BY recombinant_flanks DESC NULLS LAST, rpp_carrier DESC NULLS LAST,
                                  rpp_noncarrier DESC NULLS LAST, drag_total_est NULLS LAST, missing_rate NULLS LAST, sample_id) AS f
        FROM scored WHERE passes_filters) o USING (sample_id)""")
def w3_staged_rank(spark, sf):
    run = _run(spark, sf, ranking={"mode": "staged"})
    return ranking.ranked_samples(run).select("sample_id", "rank_overall", "rank_in_family")


@register("t1_result_order", """
    SELECT CAST(row_number() OVER (ORDER BY rank_overall NULLS LAST, sample_id) AS BIGINT) AS place, sample_id FROM ranked""")
def t1_result_order(spark, sf):
    ranked = ranking.ranked_samples(_run(spark, sf))
    return rank.positions(ranked.select("rank_overall", "sample_id"), rank.result_order(), "place").select("place", "sample_id")


CHROMS = [f"Gm{i:02d}" for i in range(1, 21)]
_CHROM_SQL = ", ".join(
    f"sum(w2 * (2 - state)) FILTER (state <= 2 AND chrom = '{c}') / nullif(sum(2 * w2) FILTER (state <= 2 AND chrom = '{c}'), 0) AS rpp_{c}"
    for c in CHROMS
)
_LOCUS_SQL = ", ".join(
    [f"max(status) FILTER (locus_id = '{t}') AS target_{t}_status" for t in ("T1", "T2", "T3")]
    + [f"max(status) FILTER (locus_id = '{a}') AS avoid_{a}_status" for a in ("V1", "V2")]
)
_DRAG_SQL = ", ".join(
    f"CAST(max(left_max) FILTER (locus_id = '{t}') AS DOUBLE) AS drag_{t}_left_max, CAST(max(right_max) FILTER (locus_id = '{t}') AS DOUBLE) AS drag_{t}_right_max, "
    f"bool_or(recombinant_left) FILTER (locus_id = '{t}') AS recomb_{t}_left, bool_or(recombinant_right) FILTER (locus_id = '{t}') AS recomb_{t}_right"
    for t in ("T1", "T2", "T3")
)


@register("k1_results_table", f"""
    SELECT CAST(rank_overall AS INT) AS rank_overall, CAST(rank_in_family AS INT) AS rank_in_family, sample_id, line_name, family_id, generation,
           passes_filters, exclusion_reason, composite_score, foreground_all_pass, avoid_all_pass, rpp_total, rpp_carrier, rpp_noncarrier,
           expected_rpp, drag_total_est, CAST(drag_total_max AS DOUBLE) AS drag_total_max, 'bp' AS drag_unit, ibs_rp, ibs_donor, missing_rate,
           het_rate, expected_het, qc_flags, role, n_informative_called, frac_a, frac_h, frac_b, 'weighted' AS background_model, 'bp' AS background_unit,
           'weighted' AS rank_mode, 'Wm82.a4' AS assembly, '1.2.0' AS results_schema, 'soybean' AS crop, '' AS call_set_db_id, '' AS sample_db_id,
           CAST(2000000 AS DOUBLE) AS background_max_marker_coverage, 'introspark' AS tool, '0.1.0' AS tool_version, CAST(NULL AS VARCHAR) AS tool_commit,
           locus.* EXCLUDE (sample_id), bounds.* EXCLUDE (sample_id), by_chrom.* EXCLUDE (sample_id), 'default' AS token_profile
    FROM ranked JOIN (SELECT sample_id, {_LOCUS_SQL} FROM status GROUP BY sample_id) locus USING (sample_id)
         JOIN (SELECT sample_id, {_DRAG_SQL} FROM drag GROUP BY sample_id) bounds USING (sample_id)
         LEFT JOIN (SELECT sample_id, {_CHROM_SQL} FROM states GROUP BY sample_id) by_chrom USING (sample_id)""")
def k1_results_table(spark, sf):
    return ranking.results(_run(spark, sf))


# --- selection -----------------------------------------------------------------------------------------------------


def _ranked(spark, sf):
    return ranking.ranked_samples(_run(spark, sf))


@register("t2_select_top_n", "SELECT sample_id, coalesce(family_id, '') AS family_id, CAST(rank_in_family AS INT) AS rank_in_family FROM ranked WHERE rank_in_family <= 2")
def t2_select_top_n(spark, sf):
    chosen = select.top_n(_ranked(spark, sf), 2).orderBy(*select.selection_order())
    return chosen.select("sample_id", F.coalesce("family_id", F.lit("")).alias("family_id"), "rank_in_family")


@register("t2_select_top_n_overall", "SELECT sample_id, CAST(rank_overall AS INT) AS rank_overall FROM ranked WHERE rank_overall <= 5")
def t2_select_top_n_overall(spark, sf):
    return select.top_n(_ranked(spark, sf), 5, per_family=False).select("sample_id", "rank_overall")


def _projection(step, a2, h2, carrier):
    return f"""
    SELECT '{step}' AS step, count(*) AS n_selected, round(avg(frac_a) + avg(frac_h) / 2, 9) AS mean_rpp_selected, round({a2} + {h2} / 2, 9) AS expected_rpp_next,
           round({h2}, 9) AS expected_het_next, CAST({carrier} AS DOUBLE) AS expected_target_carrier_fraction FROM ranked WHERE rank_in_family <= 2
    HAVING count(*) > 0"""


def _projected(spark, sf, step):
    out = select.project_next_generation(select.top_n(_ranked(spark, sf), 2), step).drop("expected_hom_donor_next")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_rpp_selected", "expected_rpp_next", "expected_het_next")})


@register("a16_project_backcross", _projection("backcross", "(avg(frac_a) + avg(frac_h) / 2)", "(avg(frac_h) / 2 + avg(frac_b))", 0.5))
def a16_project_backcross(spark, sf):
    return _projected(spark, sf, "backcross")


@register("a16_project_self", _projection("self", "(avg(frac_a) + avg(frac_h) / 4)", "(avg(frac_h) / 2)", 0.75))
def a16_project_self(spark, sf):
    return _projected(spark, sf, "self")


@register("k3_next_manifest", """
    SELECT sample_id, line_name, role, '' AS generation, '' AS family_id, coalesce(notes, '') AS notes FROM samples WHERE role LIKE '%_parent'
    UNION ALL
    SELECT sample_id || '-BC3F1-' || lpad(CAST(k AS VARCHAR), 3, '0'), line_name, 'progeny', 'BC3F1', sample_id, 'derived from ' || sample_id
    FROM ranked, range(1, 4) t(k) WHERE rank_in_family <= 2""")
def k3_next_manifest(spark, sf):
    return select.next_manifest(select.top_n(_ranked(spark, sf), 2), binding.samples(spark, sf), " BC3F1 ", 3)


@register("u3_merge_selection", """
    SELECT sample_id FROM ranked WHERE rank_in_family <= 1 UNION SELECT sample_id FROM ranked WHERE rank_overall <= 5""")
def u3_merge_selection(spark, sf):
    ranked = _ranked(spark, sf)
    return select.merge_selection(select.top_n(ranked, 1), select.top_n(ranked, 5, per_family=False))


@register("u5_still_present", "SELECT sample_id, sample_id IN (SELECT sample_id FROM ranked) AS present FROM samples")
def u5_still_present(spark, sf):
    return select.still_present(binding.samples(spark, sf), _ranked(spark, sf))


# --- navigation ------------------------------------------------------------------------------------------------------


@register("a15_family_tree", """
    SELECT CASE GROUPING_ID(family_id, generation) WHEN 3 THEN 'cross' WHEN 1 THEN 'family' ELSE 'generation' END AS level, family_id, generation, count(*) AS n
    FROM progeny GROUP BY ROLLUP (family_id, generation)""")
def a15_family_tree(spark, sf):
    return navigation.family_tree(binding.dataset(spark, sf).progeny)


@register("a15_cross_name", "SELECT max(line_name) FILTER (role = 'recurrent_parent') || ' x ' || max(line_name) FILTER (role = 'donor_parent') AS \"cross\" FROM samples")
def a15_cross_name(spark, sf):
    return navigation.cross_name(binding.samples(spark, sf))


@register("p14_filter_family_generation", "SELECT sample_id FROM progeny WHERE coalesce(family_id, '') = '' UNION ALL SELECT sample_id FROM progeny WHERE family_id = 'F3' AND generation = 'BC1F1'")
def p14_filter_family_generation(spark, sf):
    progeny = binding.dataset(spark, sf).progeny
    unassigned = navigation.filter_rows(progeny, navigation.UNASSIGNED).select("sample_id")
    return unassigned.unionByName(navigation.filter_rows(progeny, "F3", "BC1F1").select("sample_id"))


@register("p15_passing_only", "SELECT sample_id FROM scored WHERE passes_filters")
def p15_passing_only(spark, sf):
    return _scored(spark, sf).filter("passes_filters").select("sample_id")


# --- graphical genotypes ----------------------------------------------------------------------------------------------


@register("w5_segments", """
    SELECT sample_id, chrom, pos_bp, CASE WHEN seq = 1 THEN 0.0 ELSE b END AS start, coalesce(lead(b) OVER (PARTITION BY sample_id, chrom ORDER BY pos_bp, p), 1.0) AS "end", CAST(state AS INT) AS state
    FROM (SELECT *, (lag(pos_bp) OVER q + pos_bp) / 2.0e0 / greatest(coalesce(length_bp, 0), last_bp) AS b, lag(state) OVER q AS before, row_number() OVER q AS seq
          FROM states JOIN ends USING (chrom) WINDOW q AS (PARTITION BY sample_id, chrom ORDER BY pos_bp, p))
    WHERE before IS NULL OR before <> state""")
def w5_segments(spark, sf):
    data = binding.dataset(spark, sf)
    fact = classify.states(binding.progeny_calls(spark, sf), classify.classified_markers(data))
    return strips.segments(fact, strips.strip_lengths(data.markers, "Wm82.a4", data.crop)).withColumn("state", F.col("state").cast("int"))


@register("j16_locus_ticks", """
    SELECT l.chrom, locus_id, section AS kind, start_bp / greatest(coalesce(length_bp, 0), last_bp) AS start, l.end_bp / greatest(coalesce(length_bp, 0), last_bp) AS "end"
    FROM loci l JOIN ends e ON e.chrom = l.chrom""")
def j16_locus_ticks(spark, sf):
    data = binding.dataset(spark, sf)
    return strips.locus_ticks(_resolved(spark, sf)[2], strips.strip_lengths(data.markers, "Wm82.a4", data.crop))


# --- chromosome ends, map ---------------------------------------------------------------------------------------------


@register("a23_chromosome_ends", "SELECT chrom, last_bp, end_bp, coalesce(placed, false) AS placed FROM ends")
def a23_chromosome_ends(spark, sf):
    data = binding.dataset(spark, sf)
    return background.chromosome_ends(data.markers, "Wm82.a4", data.crop).select("chrom", "last_bp", "end_bp", (F.col("kind") == "placed").alias("placed"))


@register("a24_map_complete", "SELECT bool_and(cm IS NOT NULL) AS has_cm FROM markers")
def a24_map_complete(spark, sf):
    return has_cm(binding.markers(spark, sf))


@register("w6_marker_order", "SELECT marker_id, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos_bp, p) AS BIGINT) AS place FROM markers")
def w6_marker_order(spark, sf):
    placed = rank.positions(ordered_markers(binding.markers(spark, sf)), [F.asc("chrom_rank"), F.asc("pos_bp"), F.asc("file_ord")], "n")
    starts = placed.groupBy("chrom").agg(F.min("n").alias("first"))
    return placed.join(starts, "chrom").select("marker_id", (F.col("n") - F.col("first") + 1).alias("place"))
