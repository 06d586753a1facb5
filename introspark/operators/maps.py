"""Genetic maps: clean the anchors of a chromosome, and interpolate cM between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introspark.operators.background import BIN_BP
from introspark.operators.common import land, running
from introspark.operators.drag import interpolated


class _Fenwick:
    """Running maxima of a sequence of slots, each slot only ever raised."""

    def __init__(self, size: int):
        self.best = [0] * (size + 1)

    def raise_to(self, slot: int, value: int) -> None:
        while slot < len(self.best):
            self.best[slot] = max(self.best[slot], value)
            slot += slot & -slot

    def upto(self, slot: int) -> int:
        out = 0
        while slot:
            out = max(out, self.best[slot])
            slot -= slot & -slot
        return out


def _run_through(ranks: np.ndarray) -> np.ndarray:
    """For every item: the length of the longest non-decreasing run that ends in it. Ranks count from 1."""
    tree, out = _Fenwick(int(ranks.max(initial=0))), np.zeros(len(ranks), dtype=int)
    for i, rank in enumerate(ranks.tolist()):
        out[i] = tree.upto(rank) + 1
        tree.raise_to(rank, int(out[i]))
    return out


def _keep_earliest(values: np.ndarray) -> np.ndarray:
    """Mask of the longest non-decreasing subsequence whose members come earliest.

    With ``before`` the longest run ending in an item and ``after`` the longest one beginning there, an item lies on
    some longest run exactly if both add up to the whole, and then its place in that run is ``before``. Of the items
    that can take a place, positions rise while values fall; the earliest one that continues the run so far is kept.
    """
    ranks = np.unique(values, return_inverse=True)[1].reshape(-1) + 1
    before = _run_through(ranks)
    after = _run_through((len(values) + 1 - ranks)[::-1])[::-1] if len(values) else before
    whole = int(before.max(initial=0))
    kept = np.zeros(len(values), dtype=bool)
    able = np.flatnonzero(before + after == whole + 1)
    last = -1
    for place in np.split(able[np.argsort(before[able], kind="stable")], np.cumsum(np.bincount(before[able], minlength=whole + 1)[1:])[:-1]) if whole else ():
        fits = place[(place > last) & (values[place] >= values[last])] if last >= 0 else place
        last = int(fits[0])
        kept[last] = True
    return kept


def independent_stretches(anchors: DataFrame) -> DataFrame:
    """Add ``stretch``: where everything before an anchor is at or below everything from it on, a new one starts.

    A longest non-decreasing subsequence of a chromosome is the concatenation of those of its stretches, so
    the solver sees the local disorder of a map instead of whole chromosomes.
    """
    order, key = ["pos_bp", "cm", "marker_id"], ["chrom", "_bin"]
    rows = land(anchors.withColumn("_bin", F.floor(F.col("pos_bp") / BIN_BP)), "map_anchors")
    by_bin = Window.partitionBy("chrom").orderBy("_bin")
    outer = rows.groupBy(*key).agg(F.max("cm").alias("top"), F.min("cm").alias("low")).select(
        *key, F.max("top").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("low").over(by_bin.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    inside = Window.partitionBy(*key).orderBy(*order)
    below = F.greatest(F.max("cm").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_earlier"))
    above = F.least(F.min("cm").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.col("_later"))
    marked = land(
        rows.join(outer, key).select(*rows.columns, below.alias("_below"), above.alias("_above"))
        .withColumn("_cut", F.when(F.col("_below").isNull() | (F.col("_below") <= F.col("_above")), F.struct(*order))),
        "map_stretches",
    )
    return running(marked, ["chrom"], "_bin", order, F.max, F.col("_cut"), "stretch").drop("_bin", "_below", "_above", "_cut")


#: What tells a stretch: its chromosome and its first anchor.
_PIECE = ["chrom", "_pos_bp", "_cm", "_marker_id"]


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with ``kept``, from rows sorted by stretch and inside it: many short stretches are solved in one step.

    A stretch that goes on in the next frame waits for its end, so a task holds one frame and one stretch.
    """

    def starts(rows: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(rows), dtype=bool)
        out[1:] = np.any([(rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1]) for c in _PIECE], axis=0)
        return out

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        values, kept = rows["cm"].to_numpy(dtype=float), np.ones(len(rows), dtype=bool)
        first = np.flatnonzero(starts(rows))
        number = np.repeat(np.arange(len(first)), np.diff(first, append=len(rows)))
        # a stretch without a fall is kept whole
        falls = np.flatnonzero((number[1:] == number[:-1]) & ~(values[1:] >= values[:-1]))
        ends = np.append(first[1:], len(rows))
        for at in np.unique(number[falls]).tolist():
            kept[first[at] : ends[at]] = _keep_earliest(values[first[at] : ends[at]])
        return rows[["marker_id", "chrom", "pos_bp", "cm"]].assign(kept=kept)

    held: list[pd.DataFrame] = []
    for rows in frames:
        if not len(rows):
            continue
        begins = np.flatnonzero(starts(rows))
        if held and tuple(held[-1][_PIECE].iloc[-1]) == tuple(rows[_PIECE].iloc[0]):
            begins = begins[1:]
        if len(begins):
            done = [*held, rows.iloc[: begins[-1]]]
            held = []
            if sum(map(len, done)):
                yield solve(pd.concat(done))
            rows = rows.iloc[begins[-1] :]
        held.append(rows)
    if held:
        yield solve(pd.concat(held))


def monotone_anchors(anchors: DataFrame) -> DataFrame:
    """Add ``kept``: membership in each chromosome's longest non-decreasing run of cM along bp.

    The solver runs per independent stretch; stretches are dealt to tasks and stream through them in order.
    """
    rows = independent_stretches(anchors.select("marker_id", "chrom", "pos_bp", "cm"))
    flat = rows.select("marker_id", "chrom", "pos_bp", "cm", *[F.col("stretch")[c].alias(f"_{c}") for c in ("pos_bp", "cm", "marker_id")])
    dealt = flat.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "pos_bp", "cm", "marker_id")
    return dealt.mapInPandas(_solved, "marker_id string, chrom string, pos_bp long, cm double, kept boolean")


def tied_means(kept: DataFrame) -> DataFrame:
    """One anchor per position: the mean cM of the anchors that share it."""
    return kept.groupBy("chrom", "pos_bp").agg(F.avg("cm").alias("cm"))


def interpolate(queries: DataFrame, anchors: DataFrame, bin_bp: int = BIN_BP) -> DataFrame:
    """Add ``cm`` (and ``clamped``) to queries(chrom, pos_bp, ...) from anchors(chrom, pos_bp, cm), one anchor per position.

    Anchors and queries are merged by position. The last anchor at or before and the first at or after each
    row are found inside a position bin; the edges of the bins supply what lies beyond.
    """
    anchor = F.struct("pos_bp", "cm")
    null_anchor = F.lit(None).cast("struct<pos_bp:bigint,cm:double>")
    payload = [c for c in queries.columns if c not in ("chrom", "pos_bp", "cm")]
    both = (
        queries.select("chrom", "pos_bp", F.struct(*payload).alias("q"), null_anchor.alias("anchor"), F.lit(1).alias("_kind"))
        .unionByName(
            anchors.select(
                "chrom", F.col("pos_bp").cast("bigint").alias("pos_bp"), F.struct(F.col("pos_bp").cast("bigint").alias("pos_bp"), "cm").alias("anchor"),
                F.lit(0).alias("_kind"),
            ), allowMissingColumns=True,
        )
        .withColumn("_bin", F.floor(F.col("pos_bp") / bin_bp))
    )
    before = Window.partitionBy("chrom", "_bin").orderBy("pos_bp").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("chrom", "_bin").orderBy("pos_bp").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    bins = both.groupBy("chrom", "_bin").agg(F.min("anchor").alias("_first"), F.max("anchor").alias("_last"))
    earlier = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    edges = bins.select(
        "chrom", "_bin", F.max("_last").over(earlier).alias("_before"), F.min("_first").over(later).alias("_after"),
        F.min("_first").over(Window.partitionBy("chrom")).alias("_any"),
    )
    lower, upper = F.col("lower"), F.col("upper")
    x = F.col("pos_bp")
    return (
        both.withColumn("lower", F.max("anchor").over(before)).withColumn("upper", F.min("anchor").over(after))
        .filter("_kind = 1")
        .join(edges, ["chrom", "_bin"], "left")
        .withColumn("lower", F.coalesce("lower", "_before")).withColumn("upper", F.coalesce("upper", "_after"))
        .select(
            "chrom", "pos_bp", "q.*", interpolated(lower, upper, x, "pos_bp", "cm").alias("cm"),
            (F.col("_any").isNotNull() & (lower.isNull() | upper.isNull())).alias("clamped"),
        )
    )


def linkage_map(table: DataFrame, markers_in: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clean a linkage-map table and, given markers, supply their cM.

    ``table`` has marker_id, snp_id, chrom, pos_bp, cm, reject, file_ord. Returns ``mapped`` (kept anchors at
    the mean cM of their position), ``markers`` (the output map), ``counts`` (of every step) and ``problems``: markers whose
    position differs from the table's, and what makes the whole map useless (no anchor kept, no marker matched).
    """
    table = land(table, "linkage_table")
    judged = land(monotone_anchors(table.filter("reject is null")), "judged_anchors")
    kept = judged.filter("kept").select("marker_id", "chrom", "pos_bp", "cm")
    means = tied_means(kept)
    mapped = kept.select("marker_id", "chrom", "pos_bp").join(means, ["chrom", "pos_bp"]).select("marker_id", "chrom", "pos_bp", "cm")
    rejects = table.select(F.explode(F.array_compact(F.array(F.lit("rows read"), "reject"))).alias("step"))
    steps = rejects.unionByName(judged.select(F.when(F.col("kept"), "mapped").otherwise("non-monotone dropped").alias("step")))
    out = {"mapped": mapped}
    nothing = F.lit(None).cast("string").alias("marker_id")
    useless = judged.agg(F.count_if("kept").alias("n")).filter("n = 0").select(nothing, F.lit("no marker kept on any chromosome").alias("problem"))
    if markers_in is None:
        out["markers"] = mapped
        out["problems"] = useless
    else:
        matched = land(match_markers(markers_in, table), "matched_markers")
        differs = (F.col("t_pos").isNotNull()) & ((F.col("t_chrom") != F.col("chrom")) | (F.col("t_pos") != F.col("pos_bp")))
        unmatched = matched.agg(F.count(F.lit(1)).alias("n"), F.count("table_id").alias("m")).filter("n > 0 and m = 0").select(nothing, F.lit("no marker matches the table").alias("problem"))
        out["problems"] = matched.filter(differs).select("marker_id", F.lit("position differs from the table's").alias("problem")).unionByName(useless).unionByName(unmatched)
        known = mapped.select(F.col("marker_id").alias("table_id"), F.col("cm").alias("table_cm"))
        sourced = matched.join(known, "table_id", "left").withColumn("own_cm", F.col("cm"))
        given = sourced.withColumn("cm", F.coalesce("own_cm", "table_cm")).filter("cm is not null")
        asked = sourced.filter("own_cm is null and table_cm is null").select("marker_id", "chrom", "pos_bp")
        filled = interpolate(asked, means)
        renamed = matched.filter("table_id <> marker_id").select("table_id").join(
            markers_in.select(F.col("marker_id").alias("table_id")), "table_id", "left_anti"
        )
        untouched = (
            mapped.join(markers_in.select("marker_id"), "marker_id", "left_anti")
            .join(renamed.select(F.col("table_id").alias("marker_id")).distinct(), "marker_id", "left_anti")
        )
        columns = ["marker_id", "chrom", "pos_bp", "cm"]
        out["markers"] = untouched.select(columns).unionByName(given.select(columns)).unionByName(filled.select(columns))
        kept_cm = sourced.filter("own_cm is not null").select(F.lit("cM kept from --markers-in").alias("step"))
        made = filled.select(
            F.explode(F.array_compact(F.array(
                F.when(F.col("cm").isNotNull(), "interpolated").otherwise("unplaced"), F.when(F.col("clamped"), "clamped")
            ))).alias("step")
        )
        steps = steps.unionByName(kept_cm).unionByName(made)
    out["counts"] = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return out


def require_usable(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A map without problems; else the first of them, with their number, is raised."""
    row = made["problems"].agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("problem", "marker_id")).alias("p")).first()
    if row["n"]:
        raise ValueError(f"{row['p']['problem']}: {row['p']['marker_id'] or 'the whole map'} ({row['n']} problems)")
    return made


def match_markers(markers_in: DataFrame, table: DataFrame) -> DataFrame:
    """Each marker with the table row it names, by its own id, else by SNP id (first table row wins)."""
    by_id = table.select(F.col("marker_id"), F.col("marker_id").alias("_by_id"))
    by_snp = (
        table.filter("snp_id <> ''").groupBy(F.col("snp_id").alias("marker_id")).agg(F.min_by("marker_id", "file_ord").alias("_by_snp"))
    )
    placed = table.select(
        F.col("marker_id").alias("table_id"), F.when(F.col("placed"), F.col("chrom")).alias("t_chrom"),
        F.when(F.col("placed"), F.col("pos_bp")).alias("t_pos"),
    )
    return (
        markers_in.join(by_id, "marker_id", "left").join(by_snp, "marker_id", "left")
        .withColumn("table_id", F.coalesce("_by_id", "_by_snp")).drop("_by_id", "_by_snp")
        .join(placed, "table_id", "left")
    )
