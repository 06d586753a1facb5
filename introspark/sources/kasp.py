"""KASP service-lab exports: long rows or a grid, consolidated to one call per sample and marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark.functions.calls import kasp_call
from introspark.functions.text import strip
from introspark.operators.common import land
from introspark.operators.rank import positions
from introspark.sources.lines import by_file, data_rows, filled, first_by, first_lines, headed

#: Samples of one stretch of a wide line.
WIDE_CHUNK = 512


def parse_long(lines: DataFrame, controls: tuple[str, ...] = ("NTC",)) -> tuple[DataFrame, DataFrame]:
    """(calls, violations) of a sectioned long export.

    The data block starts after the first row that carries the three column names, wherever it stands.
    """
    low = F.lower("value")
    rows = headed(lines, low.contains("subjectid") & low.rlike(r"\bsnpid\b") & low.rlike(r"\bcall\b"))
    data = data_rows(rows)
    bare = rows.filter("head_ord is null").groupBy("file").agg(F.min("ord").alias("ord")).select("file", "ord", F.lit("no header row").alias("kind"), F.lit("").alias("detail"))  # only files without a header
    names = F.transform("header", lambda c: F.lower(strip(c)))
    data = data.withColumn("names", names)

    def cell(name: str):
        return F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("names", name).cast("int"), F.lit(0))), F.lit(""))

    picked = data.select("file", "ord", strip(cell("subjectid")).alias("sample_id"), strip(cell("snpid")).alias("marker_id"), cell("call").alias("token"))
    kept = picked.filter(~F.col("sample_id").isin(list(controls)))
    empty = (F.col("sample_id") == "") | (F.col("marker_id") == "")
    violations = kept.filter(empty).select("file", "ord", F.lit("empty SubjectID or SNPID").alias("kind"), F.col("token").alias("detail"))
    return _calls(kept.filter(~empty)), violations.unionByName(bare)


def _calls(cells: DataFrame) -> DataFrame:
    return cells.withColumn("c", kasp_call(F.col("token"))).select(
        "file", "ord", "sample_id", "marker_id", strip(F.col("token")).alias("token"), "c.call", "c.reason"
    )


def grid_orientation(rows: DataFrame, heads: DataFrame, markers: DataFrame) -> DataFrame:
    """(file, more): known markers among a file's header cells less those among its first cells. Files without any have no row.

    Names meet the markers by name; what is grouped by file, or by the parts of files that rows were dealt by, are counts.
    """
    part = [c for c in rows.columns if c == "_salt"]
    known = markers.select(F.col("marker_id").alias("id")).distinct()
    across = heads.select("file", *[F.lit(0).alias(c) for c in part], F.explode(F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0)))).alias("id"))
    across = across.select("file", *part, strip(F.col("id")).alias("id"), F.lit(1).alias("counts"))
    down = rows.select("file", *part, strip(F.element_at("cells", 1)).alias("id"), F.lit(-1).alias("counts"))
    return across.unionByName(down).join(known, "id").groupBy("file", *part).agg(F.sum("counts").alias("more"))


def parse_grid(lines: DataFrame, markers: DataFrame, controls: tuple[str, ...] = ("NTC",)) -> tuple[DataFrame, DataFrame]:
    """(calls, violations) of a grid with samples on one axis and markers on the other; its first line is the header.

    A file has its markers across if its header has as many known markers as its first cells, or more. Where headers are too
    large to be broadcast, this is found within the same plan: the lines are dealt once, for both, and no more is written.
    """
    heads = first_lines(lines)
    text, parts, beside = by_file(filled(lines), heads)
    part = [c for c in text.columns if c == "_salt"]
    rows = data_rows(beside(text, parts(heads), "inner"), *part)
    facing = grid_orientation(rows, heads, markers)
    # counts of a file's parts, given to each of its parts
    facing = parts(facing).groupBy("file", *part).agg(F.sum("more").alias("more")) if part else land(facing, "grid-orientation")
    lost = rows.select("file").distinct().join(facing.select("file").distinct(), "file", "left_anti")
    rows = beside(rows, facing.select("file", *part, (F.col("more") >= 0).alias("markers_across")), "inner")
    violations = lost.select("file", F.lit(0).alias("ord"), F.lit("no axis of the grid matches the markers").alias("kind"), F.lit("").alias("detail"))
    width = F.greatest(F.size("header") - 1, F.lit(0))
    cells = (
        rows.select(
            "file", "ord", "markers_across", strip(F.element_at("cells", 1)).alias("down"),
            F.posexplode(F.arrays_zip(F.slice("header", 2, width).alias("name"), F.slice("cells", 2, width).alias("cell"))).alias("at", "x"),
        )
        .select("file", F.struct("ord", "at").alias("ord"), "markers_across", "down", strip(F.col("x.name")).alias("across"), F.coalesce("x.cell", F.lit("")).alias("token"))
        .filter("down <> '' and across <> ''")
    )
    sample = F.when(F.col("markers_across"), F.col("down")).otherwise(F.col("across"))
    marker = F.when(F.col("markers_across"), F.col("across")).otherwise(F.col("down"))
    picked = cells.select("file", "ord", sample.alias("sample_id"), marker.alias("marker_id"), "token").filter(~sample.isin(list(controls)))
    return _calls(picked), violations


def conflicts(calls: DataFrame) -> DataFrame:
    """(sample_id, marker_id) whose repeated calls disagree; the order of the two alleles does not matter."""
    pair = F.array_join(F.array_sort(F.split(F.coalesce("call", F.lit("N")), "")), "")
    return calls.groupBy("sample_id", "marker_id").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).filter("low <> high").select("sample_id", "marker_id")


def consolidated(calls: DataFrame) -> DataFrame:
    """One call per sample and marker: the first in file order."""
    rows = calls.select("sample_id", "marker_id", "file", "ord", "call")
    return first_by(rows, ["sample_id", "marker_id"], ["file", "ord"]).select("sample_id", "marker_id", "call")


def missing_reasons(calls: DataFrame) -> DataFrame:
    return calls.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def unrecognised_tokens(calls: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent unrecognised call texts, and how many further distinct ones there are."""
    tally = calls.filter("reason = 'unrecognized'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    more = tally.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("n")).scalar()
    return tally.orderBy(F.desc("n"), "token").limit(limit).withColumn("n_more", more)


def unplaced(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """SNPs without a map entry."""
    return calls.select("marker_id").distinct().join(markers.select("marker_id"), "marker_id", "left_anti")


def sample_places(calls: DataFrame) -> DataFrame:
    """(sample_id, place): samples in first-seen order, counted from 0; written, a row per sample."""
    seen = calls.groupBy("sample_id").agg(F.min(F.struct("file", "ord")).alias("first_seen"))
    placed = positions(seen, [F.col("first_seen"), F.col("sample_id")], "place")
    return land(placed.select("sample_id", (F.col("place") - 1).alias("place")), "sample-places")


def wide_stretches(calls: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((marker_id, k, cells), (sample_id, place), number of samples): what a wide table holds, without its absent cells.

    Cells stand in first-seen order of their samples. Stretch ``k`` of a marker's line begins at place ``k`` times
    ``WIDE_CHUNK``; ``cells`` are its calls (at, call) in order, and every place it leaves out is ``N``. A marker whose cells
    are all silent has stretches without calls. The stretches grow with the calls, the lines with markers times samples.
    """
    order = sample_places(calls)
    n = order.count()
    placed = consolidated(calls).join(order, "sample_id").select(
        "marker_id", F.expr(f"cast(place div {WIDE_CHUNK} as int)").alias("k"),
        F.when(F.col("call").isNotNull(), F.struct((F.col("place") % WIDE_CHUNK).cast("int").alias("at"), "call")).alias("cell"),
    )
    return placed.groupBy("marker_id", "k").agg(F.array_sort(F.collect_list("cell")).alias("cells")), order, n


def _stretch_text(cells: str, width: Column) -> Column:
    """The cells of one stretch as text: before each call, and behind the last, an ``N`` for every place left out."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col(cells), i - 1)["at"])
    called = F.transform(cells, lambda c, i: F.concat(F.repeat(F.lit("N,"), c["at"] - before(i) - 1), c["call"], F.lit(",")))
    last = F.coalesce(F.get(F.col(cells), F.size(cells) - 1)["at"], F.lit(-1))
    text = F.concat(F.array_join(called, ""), F.repeat(F.lit("N,"), width.cast("int") - 1 - last))
    return F.substring(text, F.lit(1), F.length(text) - 1)


def wide_table(calls: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((marker_id, chrom, pos_bp, cells), (sample_id, place)): a line of cells per placed SNP, ``N`` where a sample has none.

    A line is put together from stretches of ``WIDE_CHUNK`` samples, so no list of all samples is made and a task holds no
    more than the lines it writes. The text has a cell for every marker and sample, as the format asks.
    """
    stretches, order, n = wide_stretches(calls)
    width = lambda k: F.least(F.lit(WIDE_CHUNK), F.lit(n) - k * WIDE_CHUNK)
    parts = stretches.select("marker_id", "k", _stretch_text("cells", width(F.col("k"))).alias("part"))
    whole = parts.groupBy("marker_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "part"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(-(-n // WIDE_CHUNK) - 1)), lambda k: F.coalesce(
        F.try_element_at("m", k), F.array_join(F.array_repeat(F.lit("N"), width(k).cast("int")), ",")))
    return whole.join(markers.select("marker_id", "chrom", "pos_bp"), "marker_id").select("marker_id", "chrom", "pos_bp", F.array_join(every, ",").alias("cells")), order


def wide_calls(stretches: DataFrame, order: DataFrame, markers: DataFrame, n: int) -> DataFrame:
    """(marker_id, chrom, pos_bp, sample_id, cell, n_cells): the called cells of a wide table by the place of their sample."""
    place = F.col("k").cast("bigint") * WIDE_CHUNK + F.col("c.at")
    cells = stretches.select("marker_id", "k", F.explode("cells").alias("c")).select("marker_id", place.alias("place"), F.col("c.call").alias("cell"))
    placed = cells.join(order, "place").join(markers.select("marker_id", "chrom", "pos_bp"), "marker_id")
    return placed.select("marker_id", "chrom", "pos_bp", "sample_id", "cell", F.lit(n).cast("bigint").alias("n_cells"))


def wide_job(calls: DataFrame, markers: DataFrame, drop_unplaced: bool = False) -> tuple[tuple[DataFrame, DataFrame], DataFrame, DataFrame]:
    """(table with sample order, counts, violations) of one export: the whole job from parsed calls to the wide table.

    Calls of one cell that disagree are violations. So are SNPs without a map entry, unless ``drop_unplaced`` asks to
    leave them out; they are counted either way. ``counts`` has the columns what, n.
    """
    place = F.lit(""), F.lit(0)
    clash = conflicts(calls).select(place[0].alias("file"), place[1].alias("ord"), F.lit("conflicting calls").alias("kind"), F.concat_ws(" ", "sample_id", "marker_id").alias("detail"))
    nowhere = unplaced(calls, markers)
    violations = clash if drop_unplaced else clash.unionByName(
        nowhere.select(place[0].alias("file"), place[1].alias("ord"), F.lit("SNP not on the map").alias("kind"), F.col("marker_id").alias("detail")))
    number = F.count(F.lit(1)).alias("n")
    counts = nowhere.agg(number).select(F.lit("unplaced SNPs").alias("what"), "n").unionByName(
        missing_reasons(calls).select(F.concat(F.lit("missing: "), "reason").alias("what"), "n"))
    return wide_table(calls, markers), counts, violations
