"""Hand-computed cases and brute-force comparisons of the analysis operators."""

import itertools
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from introspark.config import CriteriaError, criteria_from_dict
from introspark.functions.chrom import SOYBEAN
from introspark.operators import background, bitplanes, classify, dataset, drag, loci, maps, qc, rank, similarity, strips
from introspark.plans import rank as ranking

STATES = "AAHHHNHAAB"
PAIR = {"A": (0, 0), "H": (0, 1), "B": (1, 1), "X": (0, 2), "N": (None, None)}
MB = 1_000_000


def build(spark, rows, positions=None, generation="BC1F1"):
    """A dataset whose samples are state strings over markers on one chromosome; both parents homozygous."""
    n = len(next(iter(rows.values())))
    positions = positions or [(i + 1) * MB for i in range(n)]
    markers = spark.createDataFrame([(f"m{i}", "Gm01", p, None, i) for i, p in enumerate(positions)],
                                    "marker_id string, chrom string, pos_bp bigint, cm double, file_ord bigint")
    manifest = [("rp", "rp", "recurrent_parent", None, None, None), ("dp", "dp", "donor_parent", None, None, None)]
    manifest += [(s, s, "progeny", generation, "F", None) for s in rows]
    samples = spark.createDataFrame(manifest, "sample_id string, line_name string, role string, generation string, family_id string, notes string")
    everyone = {"rp": "A" * n, "dp": "B" * n, **rows}
    calls = [(f"m{i}", s, *PAIR[x]) for s, text in everyone.items() for i, x in enumerate(text) if x != "-"]
    return dataset.Dataset(markers, samples, spark.createDataFrame(calls, "marker_id string, sample_id string, a1 int, a2 int"))


def states_of(data):
    markers = classify.classified_markers(data)
    return classify.states(dataset.keep_manifest(data.calls, data.progeny), markers), markers


def near_loci(data, markers, members, flanks=None):
    calls = dataset.keep_manifest(data.calls, data.progeny)
    return loci.locus_calls(classify.states(calls, loci.with_spots(markers, members, flanks)))


def test_uninformative_reasons_in_order(spark):
    data = build(spark, {"x": "AAAAAA"})
    calls = data.calls.filter("sample_id = 'x'").unionByName(spark.createDataFrame(
        [("m0", "rp", None, None), ("m0", "dp", None, None), ("m1", "rp", 0, 0), ("m1", "dp", 0, None), ("m2", "rp", 0, 1), ("m2", "dp", 0, 1),
         ("m3", "rp", 0, 0), ("m3", "dp", 0, 1), ("m4", "rp", 0, 0), ("m4", "dp", 0, 0), ("m5", "rp", 0, 0), ("m5", "dp", 1, 1)], data.calls.schema))
    got = {r["marker_id"]: r["reason"] for r in classify.classified_markers(data.with_(calls=calls)).collect()}
    assert got == {"m0": classify.RP_MISSING, "m1": classify.DONOR_MISSING, "m2": classify.RP_HET, "m3": classify.DONOR_HET, "m4": classify.MONOMORPHIC, "m5": None}


def test_ten_markers_rpp_and_drag(spark):
    data = build(spark, {"x": STATES})
    fact, markers = states_of(data)
    labels = [r[0] for r in fact.orderBy("pos_bp").select(classify.state_label(F.col("state"))).collect()]
    assert "".join(labels) == STATES
    counted = fact.filter("state <= 2").withColumn("weight2", F.lit(1.0)).groupBy("sample_id").agg(*background.rpp_sums()).first()
    assert counted["rpp_num"] / counted["rpp_den"] == pytest.approx(6 / 9)
    criteria = criteria_from_dict({"targets": [{"id": "T", "region": "1:3,000,000-7000000"}], "flank_unit": "bp", "flank_window": MB, "assembly": "none"})
    table = loci.locus_table(spark, criteria.loci)
    members = loci.locus_members(data.markers, table)
    resolved = loci.resolved_loci(table, members)
    ends = background.chromosome_ends(data.markers, "none", SOYBEAN)
    edges = drag.locus_edges(data.markers, resolved, ends, "bp")
    flanks = drag.flank_markers(data.markers, members, edges, "bp")
    near = near_loci(data, markers, members, flanks)
    row = drag.drag_bounds(near, data.progeny, criteria.targets, edges, criteria).first()
    assert (row["left_min"], row["left_max"], row["right_min"], row["right_max"]) == (0, MB, 0, MB)
    assert row["recombinant_left"] and row["recombinant_right"]
    status = loci.locus_status(near, data.progeny, criteria.loci, resolved).first()
    assert (status["status"], status["n_counted"]) == ("pass", 4)


def test_marker_weights_ends_and_caps(spark):
    data = build(spark, {"x": "A" * 10})
    markers = classify.classified_markers(data)
    ends = spark.createDataFrame([("Gm01", "placed", 20 * MB)], "chrom string, kind string, end_bp bigint")
    got = {r["marker_id"]: r["weight2"] / 2 for r in background.marker_weights(markers, ends, "bp", 10 * MB).collect()}
    assert got["m0"] == 1.5 * MB and got["m9"] == 5.5 * MB and got["m4"] == MB


def run_rule(states, positions, satisfying, anchor, min_run, tolerate):
    kept = [(p, s in satisfying) for p, s in zip(positions, states, strict=True) if s in "AHB"]
    if not kept:
        return "unknown"
    ok = [s for _, s in kept]
    joined = [x or (tolerate and 0 < i < len(ok) - 1 and ok[i - 1] and ok[i + 1]) for i, x in enumerate(ok)]
    at_or_before = [i for i, (p, _) in enumerate(kept) if p <= anchor]
    at_or_after = [i for i, (p, _) in enumerate(kept) if p >= anchor]
    if not at_or_before or not at_or_after:
        return "fail"
    lo, hi = sorted((at_or_before[-1], at_or_after[0]))
    if not all(joined[lo : hi + 1]):
        return "fail"
    while lo and joined[lo - 1]:
        lo -= 1
    while hi + 1 < len(ok) and joined[hi + 1]:
        hi += 1
    return "pass" if sum(ok[lo : hi + 1]) >= min_run else "fail"


@pytest.mark.parametrize("tolerate", [True, False])
def test_run_rule_against_a_plain_loop(spark, tolerate):
    rng = random.Random(5)
    positions = sorted(rng.choice(range(1, 15)) for _ in range(14))
    rows = {f"s{i:03d}": "".join(rng.choice("AHHHHBNX-") for _ in positions) for i in range(150)}
    rows = {s: t for s, t in rows.items() if set(t) != {"-"}}
    data = build(spark, rows, positions)
    spec = {"id": "T", "chrom": "1", "start_bp": 1, "end_bp": 14, "rule": "run", "min_run": 3, "anchor_bp": 7, "tolerate_isolated": tolerate}
    criteria = criteria_from_dict({"targets": [spec], "assembly": "none"})
    table = loci.locus_table(spark, criteria.loci)
    members = loci.locus_members(data.markers, table)
    near = near_loci(data, classify.classified_markers(data), members)
    status = loci.locus_status(near, data.progeny, criteria.loci, loci.resolved_loci(table, members))
    got = {r["sample_id"]: r["status"] for r in status.collect()}
    assert got == {s: run_rule(t, positions, "HB", 7, 3, tolerate) for s, t in rows.items()}


def test_only_the_written_states_join_calls_with_markers(spark):
    """With automatic broadcasts off, nothing after the states is dealt by marker, and each of both outcomes has one shuffle of calls."""
    rng = random.Random(3)
    data = build(spark, {f"s{i}": "".join(rng.choice("AAHBN") for _ in range(10)) for i in range(6)})
    criteria = criteria_from_dict({"targets": [{"id": "T", "region": "1:3,000,000-7000000", "rule": "any"}], "flank_unit": "bp", "flank_window": MB, "assembly": "none"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = ranking.analyse(data, criteria)
        plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in
                 (("status", run.status), ("drag", run.drag), ("sums", qc.metrics_by_chromosome(run.states)))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, plan in plans.items():
        assert not re.search(r"hashpartitioning\(marker_id", plan), (name, plan)
        # one exchange of calls and, for outcomes per locus, one of the samples
        assert plan.count("Exchange hashpartitioning") == (1 if name == "sums" else 2), (name, plan)


def test_drag_against_a_plain_walk(spark):
    rng = random.Random(8)
    rows = {f"s{i:02d}": "".join(rng.choice("AAHHBNX") for _ in range(12)) for i in range(40)}
    data = build(spark, rows)
    criteria = criteria_from_dict({"targets": [{"id": "T", "marker_id": "m5"}], "flank_unit": "bp", "flank_window": 2 * MB, "assembly": "none"})
    table = loci.locus_table(spark, criteria.loci)
    members = loci.locus_members(data.markers, table)
    edges = drag.locus_edges(data.markers, loci.resolved_loci(table, members), background.chromosome_ends(data.markers, "none", SOYBEAN), "bp")
    near = near_loci(data, classify.classified_markers(data), members, drag.flank_markers(data.markers, members, edges, "bp"))
    bounds = drag.drag_bounds(near, data.progeny, criteria.targets, edges, criteria)

    def walk(steps, end):
        inner = 0
        for d, s in steps:
            if s == "A":
                return inner, d
            if s in "HB":
                inner = d
        return inner, end

    for r in bounds.collect():
        t = rows[r["sample_id"]]
        left = walk([((5 - i) * MB, t[i]) for i in range(4, -1, -1)], 6 * MB)
        right = walk([((i - 5) * MB, t[i]) for i in range(6, 12)], 6 * MB)
        assert (r["left_min"], r["left_max"], r["right_min"], r["right_max"]) == (*left, *right), r["sample_id"]


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = {f"s{i:02d}": "".join(rng.choice("AAHBX--N") for _ in range(30)) for i in range(12)}
    rows["s99"] = rows["s00"]
    data = build(spark, rows)
    progeny = data.progeny.withColumn("sample_ord", F.col("sample_id"))
    calls = dataset.keep_manifest(data.calls, progeny)
    found = similarity.duplicate_scan(calls, data.markers, progeny, 30, len(rows), threshold=0.6, min_overlap=0.2)
    got = {(r["sample_a"], r["sample_b"]): (r["ibs"], r["n_overlap"]) for r in found.collect() if r["sample_a"]}

    def shared(x, y):
        rest, n = list(PAIR[y]), 0
        for allele in PAIR[x]:
            if allele in rest:
                rest.remove(allele)
                n += 1
        return n

    want, skipped = {}, 0
    for a, b in itertools.combinations(sorted(rows), 2):
        both = [(x, y) for x, y in zip(rows[a], rows[b], strict=True) if x in "AHBX" and y in "AHBX"]
        if len(both) < 6:
            skipped += 1
        elif sum(shared(x, y) for x, y in both) / (2 * len(both)) >= 0.6:
            want[(a, b)] = (sum(shared(x, y) for x, y in both) / (2 * len(both)), len(both))
    assert got == want and ("s00", "s99") in got
    assert similarity.skipped_pairs(found, len(rows)).first()["n_skipped"] == skipped


def test_grouped_median_is_exact(spark):
    rng = random.Random(1)
    values = {k: [rng.randrange(50) / 50 for _ in range(n)] for k, n in (("a", 7), ("b", 8), ("c", 1), ("d", 301))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: r["median"] for r in qc.grouped_median(df, ["k"], "v", scale=16).collect()}
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_both_outlier_paths_agree(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", f"f{i % 5}", 0.9 if i % 17 == 0 else rng.random() / 5) for i in range(200)]
    shares = spark.createDataFrame(rows, "sample_id string, family string, donor double")
    big = {r[0] for r in qc.family_outliers(shares).collect()}
    assert big and big == {r[0] for r in qc.small_family_outliers(shares).collect()}


def test_positions_number_a_total_order(spark):
    df = spark.range(1000).select(F.expr("id % 7").alias("k"), F.expr("cast((id * 37) % 1000 as int)").alias("v"))
    got = [r["n"] for r in rank.positions(df, [F.desc("k"), F.asc("v")], "n").orderBy(F.desc("k"), "v").collect()]
    assert got == list(range(1, 1001))


def test_monotone_anchors_against_brute_force(spark):
    rng = random.Random(4)
    for trial in range(4):
        n = 9
        cm = [rng.randrange(6) for _ in range(n)]
        df = spark.createDataFrame([(f"m{i}", "Gm01", (i + 1) * 700_000, float(v)) for i, v in enumerate(cm)],
                                   "marker_id string, chrom string, pos_bp bigint, cm double")
        kept = [int(r["marker_id"][1:]) for r in maps.monotone_anchors(df).filter("kept").collect()]
        chains = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(cm[x] <= cm[y] for x, y in zip(c, c[1:], strict=False))]
        longest = max(map(len, chains))
        assert sorted(kept) == list(min(c for c in chains if len(c) == longest)), (trial, cm)


def test_segments_tile_the_chromosome(spark):
    data = build(spark, {"x": STATES})
    fact, _ = states_of(data)
    lengths = strips.strip_lengths(data.markers, "none", SOYBEAN)
    got = [(r["start"], r["end"], r["state"]) for r in strips.segments(fact, lengths).orderBy("pos_bp").collect()]
    assert got[0][0] == 0.0 and got[-1][1] == 1.0
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert "".join("AHBXNU"[s] for _, _, s in got) == "AHNHAB"
    assert got[0][1] == pytest.approx(0.25)


def test_results_do_not_depend_on_partitioning(spark):

    rng = random.Random(6)
    rows = {f"s{i:02d}": "".join(rng.choice("AAAHHB-") for _ in range(20)) for i in range(12)}
    criteria = criteria_from_dict({"targets": [{"id": "T", "marker_id": "m5", "rule": "any"}], "filters": {"max_missing_rate": 0.9, "unknown_target_is": "pass"}})
    seen = []
    for parts in (1, 5):
        data = build(spark, rows)
        data = data.with_(calls=data.calls.repartition(parts), markers=data.markers.repartition(parts))
        out = ranking.results(ranking.analyse(data, criteria))
        seen.append(sorted(map(str, out.collect())))
        assert out.columns[0] == "rank_overall" and out.columns[-1] == "token_profile" and len([c for c in out.columns if c == "rpp_Gm01"]) == 1
    assert seen[0] == seen[1]


def test_criteria_are_validated():
    ok = {"targets": [{"id": "T", "marker_id": "m"}]}
    criteria_from_dict(ok)
    for bad in ({}, {"targets": [{"id": "T"}]}, {**ok, "colour": 1}, {**ok, "flank_window": 0}, {**ok, "weights": {"drag": -1}},
                {"targets": [{"id": "T", "marker_id": "m", "rule": "run"}]}, {**ok, "avoid": [{"id": "T", "marker_id": "n"}]}):
        with pytest.raises(CriteriaError):
            criteria_from_dict(bad)


def test_each_parent_role_is_named_once(spark):
    data = build(spark, {"s00": "AH"})
    twice = data.with_(samples=data.samples.unionByName(data.samples.filter("role = 'donor_parent'").withColumn("sample_id", F.lit("other"))))
    with pytest.raises(ValueError):
        twice.parent_calls()
    assert {r["role"] for r in data.parent_calls().collect()} == {"recurrent_parent", "donor_parent"}


@pytest.mark.parametrize(("seed", "density", "min_ibs", "floor"), [(1, 0.9, 0.995, 100), (2, 0.3, 0.8, 20), (3, 0.5, 0.6, 1), (4, 0.97, 0.9, 190), (5, 0.02, 0.9, 3)])
def test_bit_planes_and_bounds(monkeypatch, seed, density, min_ibs, floor):
    """Blocks of several chunks and steps, with copies, near copies, rare alleles and samples without calls, against all pairs counted plainly."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    monkeypatch.setattr(bitplanes, "CHUNK", 128)
    monkeypatch.setattr(bitplanes, "STEP", 64)
    rng, n, m, per_block = np.random.default_rng(seed), 23, 300, 10
    calls = rng.choice([0, 1, 1, 2, 126], (n, m, 2)) if seed % 2 else rng.integers(0, 2, (n, m, 2))
    known = rng.random((n, m)) < density
    for copy, of in ((5, 2), (17, 2), (22, 21)):
        calls[copy], known[copy] = calls[of], known[of] & (rng.random(m) < 0.98)
    calls[17, :2] = 1 - np.minimum(calls[17, :2], 1)
    known[9] = False
    packed = []
    for block in range(3):
        for chunk in range(-(-m // 128)):
            at = [(r, c) for r in range(per_block) for c in range(128) if block * per_block + r < n and chunk * 128 + c < m and known[block * per_block + r, chunk * 128 + c]]
            if at:
                values = np.array([calls[block * per_block + r, chunk * 128 + c] for r, c in at], np.int32)
                table = pa.table({"row": pa.array([r for r, _ in at], pa.int32()), "at": pa.array([c for _, c in at], pa.int32()), "n_at": pa.array([min(128, m - chunk * 128)] * len(at), pa.int32()), "a1": values[:, 0], "a2": values[:, 1]})
                packed.append(bitplanes.pack((pa.scalar("x"), pa.scalar(block), pa.scalar(chunk)), table))
    table, kernel = pa.concat_tables(packed), bitplanes.pair_kernel(min_ibs, floor, m)
    got, assessed = {}, 0
    for i in range(3):
        for j in range(i, 3):
            part = table.filter(pc.is_in(table.column("block"), value_set=pa.array([i, j])))
            for r in kernel((pa.scalar("x"), pa.scalar(i), pa.scalar(j)), part).to_pylist():
                assessed += r["n_assessed"]
                if r["a"] is not None:
                    got[i * per_block + r["a"], j * per_block + r["b"]] = (r["n_overlap"], r["n_shared"])
    want, reached = {}, 0
    for a, b in itertools.combinations(range(n), 2):
        both = np.flatnonzero(known[a] & known[b])
        shared = sum((Counter(calls[a, k].tolist()) & Counter(calls[b, k].tolist())).total() for k in both)
        reached += len(both) >= floor
        if len(both) >= floor and shared / (2 * len(both)) >= min_ibs:
            want[a, b] = (len(both), shared)
    assert got == want and assessed == reached and (want or density < 0.1)


def test_bounds_end_a_scan_early(monkeypatch):
    """Unlike samples with all calls are settled after one step: no later plane is read."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bitplanes, "CHUNK", 128)
    monkeypatch.setattr(bitplanes, "STEP", 64)
    parts = []
    for chunk in range(4):
        row, at = np.repeat(np.arange(6, dtype=np.int32), 128), np.tile(np.arange(128, dtype=np.int32), 6)
        parts.append(bitplanes.pack((pa.scalar(""), pa.scalar(0), pa.scalar(chunk)), pa.table({"row": row, "at": at, "n_at": np.full(len(row), 128, np.int32), "a1": row, "a2": row})))
    read = []
    plain = bitplanes.Block.plane
    monkeypatch.setattr(bitplanes.Block, "plane", lambda self, chunk, name, words: (read.append((chunk, words.start, name)), plain(self, chunk, name, words))[1])
    out = bitplanes.pair_kernel(0.995, 300, 512)((pa.scalar(""), pa.scalar(0), pa.scalar(0)), pa.concat_tables(parts)).to_pylist()
    assert [r["n_assessed"] for r in out] == [15]
    assert {(c, w) for c, w, name in read if name != "present"} <= {(0, 0)}


def test_map_job_refuses_what_is_useless(spark):
    schema = "marker_id string, snp_id string, chrom string, pos_bp long, cm double, placed boolean, reject string, file_ord int"
    table = spark.createDataFrame([("ss1", "a", "Gm01", 5, 1.0, True, None, 0), ("ss2", "b", "Gm01", 9, 2.0, True, None, 1), ("ss3", "c", "Gm01", 7, None, True, "LG mismatch", 2)], schema)
    asked = lambda *rows: spark.createDataFrame(rows, "marker_id string, chrom string, pos_bp long, cm double")
    made = maps.require_usable(maps.linkage_map(table, asked(("a", "Gm01", 5, None), ("x", "Gm01", 7, None))))
    assert {(r["marker_id"], r["cm"]) for r in made["markers"].collect()} == {("a", 1.0), ("x", 1.5), ("ss2", 2.0)}
    with pytest.raises(ValueError, match="position differs.*ss2 \\(1 problems"):
        maps.require_usable(maps.linkage_map(table, asked(("ss2", "Gm01", 8, None))))
    with pytest.raises(ValueError, match="no marker matches"):
        maps.require_usable(maps.linkage_map(table, asked(("x", "Gm01", 8, None))))
    with pytest.raises(ValueError, match="no marker kept"):
        maps.require_usable(maps.linkage_map(table.filter("reject is not null")))
