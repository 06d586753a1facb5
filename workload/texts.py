"""Text inputs derived from the bound tables: one line per record, in files of a few samples.

Files hold four samples (a batch of neighbouring suppliers) and only markers with a call in the batch, so
the text grows linearly with lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.operators.common import land
from introspark.sources.lines import per_file
from workload import binding

BATCH = 4
#: Markers of a page.
PAGE = 100


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """(b, names): the samples of each file."""
    s = binding.table(spark, sf, "supplier").selectExpr("s_suppkey div 4 as b", "s_suppkey as s")
    return s.groupBy("b").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.concat(F.lit("s"), x.cast("string"))).alias("names"))


def batch_cells(spark: SparkSession, sf: str, page: int | None = None) -> DataFrame:
    """(b, p, n, c0, c1, ...): per batch and marker, the calls of the batch's ``n`` samples (NULL where none was made)."""
    sizes = land(batches(spark, sf).select(F.col("b").alias("file"), F.size("names").alias("n")), "batch-sizes")
    cells = binding.batch_calls(spark, sf, BATCH, page).withColumnsRenamed({"b": "file", "p": "ord"})
    return per_file(cells, sizes, "inner").withColumnsRenamed({"file": "b", "ord": "p"})


def _each(made: Callable[[Column, int], Column]) -> Column:
    """What ``made`` gives for the call and the number of each of the batch's samples, as an array."""
    return F.slice(F.array(*[made(F.col(f"c{k}"), k) for k in range(BATCH)]), 1, F.col("n"))


def _spelled(c: Column, style: Column, absent: str | None, *rules: Callable[[int | None, int | None], str | None]) -> Column:
    """The text of a call by the rule numbered ``style``: looked up among the texts of all calls.

    ``absent`` stands for a call that was not made; without it that is read as one with both sides missing.
    """
    sides = (None, 0, 1, 2)
    listed = [text for rule in rules for text in [*[rule(x, y) for x in sides for y in sides], rule(None, None) if absent is None else absent]]
    place = F.when(c.isNull(), 16).otherwise(F.coalesce(c["a1"] + 1, F.lit(0)) * 4 + F.coalesce(c["a2"] + 1, F.lit(0)))
    return F.get(F.array(*[F.lit(text).cast("string") for text in listed]), style * 17 + place)


def _file(prefix: str, extension: str) -> Column:
    return F.concat(F.lit(prefix), F.col("b").cast("string"), F.lit(extension))


def _lines(body: DataFrame, *heads: DataFrame) -> DataFrame:
    out = body
    for h in heads:
        out = out.unionByName(h)
    # written first, as a file would be: a parser looks at its lines more than once
    return land(out.select("file", F.col("ord").cast("bigint").alias("ord"), "value"), "lines")


def vcf_lines(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    layout = F.expr("p % 3")
    before, after = F.when(layout == 0, "12:").otherwise(""), F.when(layout == 1, ":7").otherwise("")
    short = F.when(F.col("p") % 7 == 0, 1).otherwise(0)

    def cell(c: Column, k: int) -> Column:
        def both(x: int | None, y: int | None) -> str:
            return "|/"[k % 2 == 0].join("." if a is None else str(a) for a in (x, y))

        g = _spelled(c, short, ".", both, lambda x, y: str(x) if x is not None and x == y else both(x, y))
        planted = {1: F.when(F.col("p") % 97 == 5, "0/01"), 2: F.when(F.col("p") % 89 == 7, "0/3")} if broken else {}
        return F.concat(before, planted[k].otherwise(g) if k in planted else g, after)

    form = F.when(layout == 0, "DP:GT").when(layout == 1, "GT:DP").otherwise("GT")
    chrom = F.when(layout == 0, F.expr("concat('Chr', 1 + p % 20)")).when(layout == 1, F.expr("concat('Gm', lpad(cast(1 + p % 20 as string), 2, '0'))")).otherwise(
        F.expr("concat('glyma.Wm82.gnm4.Gm', lpad(cast(1 + p % 20 as string), 2, '0'))")
    )
    position = F.expr("cast((p div 20 + 1) * 30000 as string)")
    if broken:
        position = F.when(F.col("p") % 101 == 9, "3e4").otherwise(position)
    name = F.when(F.col("p") % 11 == 0, ".").otherwise(F.concat(F.lit("m"), F.col("p").cast("string")))
    body = batch_cells(spark, sf).select(
        _file("batch", ".vcf").alias("file"), (F.col("p") + 3).alias("ord"),
        F.concat_ws("\t", chrom, position, name, F.lit("A"), F.lit("C,G"), F.lit("."), F.lit("PASS"), F.lit("."), form, F.array_join(_each(cell), "\t")).alias("value"),
    )
    fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    per_file = batches(spark, sf)
    heads = per_file.select(
        _file("batch", ".vcf").alias("file"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("ord"), F.lit("##fileformat=VCFv4.2").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit(" ").alias("value")),
            F.struct(F.lit(2).alias("ord"), F.concat(F.lit(fixed), F.array_join("names", "\t")).alias("value")),
        )),
    )
    return _lines(body, heads)


def _symbol(a: Column) -> Column:
    return F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("G")), a + 1)


def _nucleotides() -> Column:
    """Batch calls as nucleotide cells in several accepted spellings."""

    def spelling(style: int) -> Callable[[int | None, int | None], str | None]:
        def cell(x: int | None, y: int | None) -> str | None:
            if y is None:
                return "NN" if x is None else "ACG"[x] + "/N"
            if x is None:
                return None
            x, y = "ACG"[x], "ACG"[y]
            if style == 1:
                return "m" if {x, y} == {"A", "C"} else f"{x}|{y}"
            return f"{y}/{x}" if style == 2 else x if x == y else x + y

        return cell

    def cell(c: Column, k: int) -> Column:
        return _spelled(c, F.expr(f"cast((b * {BATCH} + {k}) % 3 as int)"), "NN", *[spelling(style) for style in range(3)])

    return _each(cell)


def _marker_name() -> Column:
    """A marker of one batch file: names must be unique across the files of a dataset."""
    return F.concat(F.lit("m"), F.col("p").cast("string"), F.lit("b"), F.col("b").cast("string"))


def hapmap_lines(spark: SparkSession, sf: str) -> DataFrame:
    fixed = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode"
    body = batch_cells(spark, sf).select(
        _file("batch", ".hmp.txt").alias("file"), (F.col("p") + 1).alias("ord"),
        F.concat_ws(
            "\t", _marker_name(), F.lit("A/C"), F.expr("cast(1 + p % 20 as string)"), F.expr("cast((p div 20 + 1) * 30000 as string)"),
            F.lit("+\tNA\tNA\tNA\tNA\tNA\tNA"), F.array_join(_nucleotides(), "\t"),
        ).alias("value"),
    )
    heads = batches(spark, sf).select(_file("batch", ".hmp.txt").alias("file"), F.lit(0).alias("ord"), F.concat(F.lit(fixed + "\t"), F.array_join("names", "\t")).alias("value"))
    return _lines(body, heads)


def wide_lines(spark: SparkSession, sf: str, tokens: str = "nucleotide") -> DataFrame:
    """tokens: nucleotide, coded (A/B/H/N by parental state), kasp (X:Y tokens) or het (one symbol, H for a heterozygote)."""

    def silent(x: int | None, y: int | None) -> bool:
        return x is None or y is None or y == 2

    def coded(c: Column, k: int) -> Column:
        rules = [lambda x, y, r=r: "N" if silent(x, y) else "a" if x == y == r else "B" if x == y else "H" for r in range(2)]
        return _spelled(c, F.expr("cast(p % 2 as int)"), "N", *rules)

    def kasp(c: Column, k: int) -> Column:
        rules = [lambda x, y, none=none: none if silent(x, y) else f"{'YX'[x == 0]}:{'YX'[y == 0]}" for none in ("?", "uncallable")]
        return _spelled(c, F.expr("cast(p % 2 as int)"), None, *rules)

    def het(c: Column, k: int) -> Column:
        return _spelled(c, F.lit(0), "U", lambda x, y: "U" if silent(x, y) else "ACG"[x] if x == y else "H")

    cells = {"nucleotide": _nucleotides, "coded": lambda: _each(coded), "kasp": lambda: _each(kasp), "het": lambda: _each(het)}[tokens]()
    chrom = F.when(F.col("p") % 3 == 0, F.expr("concat('\"chr ', 1 + p % 20, '\"')")).otherwise(F.expr("concat('LG', 1 + p % 20)"))
    body = batch_cells(spark, sf).select(
        _file("batch", ".csv").alias("file"), (F.col("p") + 2).alias("ord"),
        F.concat_ws(",", _marker_name(), chrom, F.expr("concat((p div 20 + 1) * 3, 'E4')"), F.array_join(cells, ",")).alias("value"),
    )
    heads = batches(spark, sf).select(
        _file("batch", ".csv").alias("file"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("ord"), F.concat(F.lit("Marker_ID,chrom,pos_bp,"), F.array_join("names", ",")).alias("value")),
            F.struct(F.lit(1).alias("ord"), F.lit(",, ,").alias("value")),
        )),
    )
    return _lines(body, heads)


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    body = binding.samples(spark, sf).select(
        F.lit("samples.csv").alias("file"), (F.col("sample_ord") + 1).alias("ord"),
        F.concat_ws(
            ",", "sample_id", "line_name", F.upper("role"), F.coalesce("generation", F.lit("")), F.coalesce("family_id", F.lit("")),
            F.coalesce(F.concat(F.lit('"'), "notes", F.lit('"')), F.lit("")),
        ).alias("value"),
    )
    spark_head = binding.table(spark, sf, "supplier").groupBy().agg(F.lit("samples.csv").alias("file"), F.lit(0).alias("ord"), F.lit("Sample_ID,line_name,Role,generation,family_id,notes").alias("value"))
    return _lines(body, spark_head)


def map_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A marker map that moves some markers, lacks others and leaves some cM open."""
    p = binding.table(spark, sf, "part")
    at = "(p_partkey div 20 + 1) * 30000 + if(p_size = 7, 500, 0)"
    body = p.filter("p_size <> 9").select(
        F.lit("markers.csv").alias("file"), F.expr("p_partkey + 1").alias("ord"),
        F.expr(
            f"""concat_ws(',', concat('m', p_partkey), concat('Gm', 1 + p_partkey % 20),
                case p_size % 3 when 0 then cast({at} as string) when 1 then concat('+', {at}, '.0') else concat(({at}) div 100, 'e2') end,
                case when p_size = 11 then 'NA' when p_size = 12 then '' else cast((p_partkey div 20 + 1) * 0.075D as string) end)"""
        ).alias("value"),
    )
    head = p.groupBy().agg(F.lit("markers.csv").alias("file"), F.lit(0).alias("ord"), F.lit("marker_id,chrom,pos_bp,cm").alias("value"))
    return _lines(body, head)


def kasp_long_lines(spark: SparkSession, sf: str, conflicting: bool = False) -> DataFrame:
    """Sectioned long exports: preamble, then one row per call; some rows are repeated with the alleles swapped."""
    calls = batch_cells(spark, sf).select("b", "p", F.posexplode(_each(lambda c, k: c)).alias("k", "c")).filter("c is not null")
    x, y = _symbol(F.col("c.a1")), _symbol(F.col("c.a2"))
    silent = F.col("c.a1").isNull() | F.col("c.a2").isNull()
    missing = F.when(F.col("p") % 3 == 0, "?").when(F.col("p") % 3 == 1, "UNCALLABLE").otherwise(F.concat(F.lit("bad call "), (F.col("p") % 7).cast("string")))
    sep = F.element_at(F.array(F.lit(":"), F.lit("-"), F.lit("."), F.lit("")), (F.col("p") % 4 + 1).cast("int"))
    token = F.when(silent, missing).otherwise(F.concat(x, sep, y))
    again = F.when(silent, missing).otherwise(F.concat(y, F.lit(":"), x))
    if conflicting:
        again = F.when(~silent & (F.col("p") % 29 == 1), "TT").otherwise(again)
    rows = F.when(F.col("p") % 13 == 1, F.array(token, again)).otherwise(F.array(token))
    exploded = calls.select("b", "p", "k", F.col("c.s").alias("s"), F.posexplode(rows).alias("again", "token"))
    body = exploded.select(
        _file("kasp", ".csv").alias("file"), (F.lit(100) + F.col("p") * 8 + F.col("k") * 2 + F.col("again")).alias("ord"),
        F.concat_ws(",", F.lit("plate"), F.concat(F.lit("m"), "p"), F.concat(F.lit("s"), "s"), "token", F.lit("x")).alias("value"),
    )
    heads = batches(spark, sf).select(
        _file("kasp", ".csv").alias("file"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("ord"), F.lit("Statistics").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit("SNPID,SNPNum,AlleleY").alias("value")),
            F.struct(F.lit(2).alias("ord"), F.lit("m1,1,C").alias("value")), F.struct(F.lit(3).alias("ord"), F.lit("Plate,SNPID,SubjectID,Call,Note").alias("value")),
            F.struct(F.lit(4).alias("ord"), F.lit("plate,m1,NTC,AA,x").alias("value")),
        )),
    )
    return _lines(body, heads)


def page_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(b, page, names, rows): the batch cells of up to 100 neighbouring markers, as one array."""
    cells = batch_cells(spark, sf, PAGE).select("b", "page", "p", "n", _each(lambda c, k: c).alias("c"))
    pages = cells.groupBy("b", "page").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("rows"), F.first("n").alias("n"))
    # the cells are those of the batch's first n samples: joined with the names of all batches, pages would be dealt again
    names = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.concat(F.lit("s"), (F.col("b") * BATCH + k).cast("string")))
    return pages.select("b", "page", names.alias("names"), "rows")


def kasp_grid_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Grids of one page each; odd batches have markers down and samples across."""
    pages = page_cells(spark, sf)
    cell = lambda c: F.when(c.isNull() | c["a1"].isNull() | c["a2"].isNull(), "?").otherwise(F.concat(_symbol(c["a1"]), F.lit(":"), _symbol(c["a2"])))
    marker_names = F.transform("rows", lambda r: F.concat(F.lit("m"), r["p"].cast("string")))
    file = F.concat(F.lit("grid"), F.col("b").cast("string"), F.lit("_"), F.col("page").cast("string"), F.lit(".csv"))
    down = F.concat(
        F.array(F.concat(F.lit("DNA,"), F.array_join("names", ","))),
        F.transform("rows", lambda r: F.concat(F.lit("m"), r["p"].cast("string"), F.lit(","), F.array_join(F.transform(r["c"], cell), ","))),
    )
    across = F.concat(
        F.array(F.concat(F.lit("DNA,"), F.array_join(marker_names, ","))),
        F.transform("names", lambda n, i: F.concat(n, F.lit(","), F.array_join(F.transform("rows", lambda r: cell(F.element_at(r["c"], i + 1))), ","))),
    )
    return _lines(pages.select(file.alias("file"), F.posexplode(F.when(F.expr("b % 2 = 1"), down).otherwise(across)).alias("ord", "value")))


def gff3_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Position files of two assemblies and two panels, made from the parts' sizes and brands."""
    p = binding.table(spark, sf, "part")
    files = F.array(*[
        F.struct(F.lit(f"glyma.Wm82.{a}.mrk.{panel}.gff3").alias("file"), F.lit(a).alias("a"), F.lit(shift).alias("shift"), F.lit(panel).alias("panel"))
        for a, shift in (("gnm1", 7), ("gnm2", 0)) for panel in ("SoySNP50K", "SoySNP6K")
    ])
    rows = p.select("p_partkey", "p_size", "p_brand", F.inline(files)).filter("(panel = 'SoySNP50K' and p_size > 10) or (panel = 'SoySNP6K' and p_size <= 25)")
    body = rows.select(
        "file", (F.col("p_partkey") + 1).alias("ord"),
        F.expr(
            """concat_ws('\t', concat('glyma.Wm82.', a, '.', if(p_size = 50, concat('scaffold_', p_partkey), concat('Gm', lpad(cast(1 + p_partkey % 20 as string), 2, '0')))),
               'snp', 'marker', cast((p_partkey div 20 + 1) * 30000 + shift + if(panel = 'SoySNP6K', 3, 0) as string), '0', '.', '+', '.',
               concat('ID=x', p_partkey, '; Name=m', p_partkey, ';Alias=', p_brand, '=1'))"""
        ).alias("value"),
    )
    heads = p.groupBy().agg(F.lit(0).alias("ord")).select(F.explode(F.transform(files, lambda x: x["file"])).alias("file"), "ord", F.lit("##gff-version 3").alias("value"))
    return _lines(body, heads)


def linkage_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A published-map table with rejects of every kind and locally disordered cM."""
    p = binding.table(spark, sf, "part")
    body = p.select(
        F.lit("map.csv").alias("file"), (F.col("p_partkey") + 2).alias("ord"),
        F.expr(
            """concat_ws(',', concat(p_partkey, '.0'), concat('snp', p_partkey), 'x',
               if(p_size = 1, 'scaffold_21', concat('Gm', lpad(cast(1 + p_partkey % 20 as string), 2, '0'))),
               if(p_size = 2, '', cast((p_partkey div 20 + 1) * 30000 as string)),
               if(p_size = 3, '', cast(if(p_size = 4, 20, 1) + if(p_size = 4, 0, p_partkey % 20) as string)),
               if(p_size = 5, 'n/a', cast((p_partkey div 20 + 1) * 0.075D + if(p_size > 44, p_size - 44, 0) * 0.05D as string)))"""
        ).alias("value"),
    )
    heads = p.groupBy().agg(F.lit("map.csv").alias("file")).select("file", F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("Table S1").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("ss ID,SNP ID,Note,Wm82.a2.v1 Chromosome,Wm82.a2.v1 Coordinate,WP Linkage Group,WP linkage position").alias("value")),
    )))
    return _lines(body, heads)


def pedigree_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = binding.table(spark, sf, "supplier")
    cross = "concat('Clark (', 1 + s_suppkey % 6, ') x ', if(s_nationkey < 12, 'PI86024', 'PI80837'))"
    rows = s.select("s_suppkey", F.expr(
        f"""array(concat('"', if(s_suppkey % 9 = 8, 'L', 'PI'), s_suppkey, '",', if(s_suppkey % 2 = 0, concat('PI548533,', {cross}), concat({cross}, ',Clark'))),
                  concat('PI', s_suppkey, ',Clark,Clark (9) x PI86024'))"""
    ).alias("r"))
    body = rows.select(F.lit("pedigrees.csv").alias("file"), "s_suppkey", F.posexplode("r").alias("again", "value")).select("file", (F.col("s_suppkey") * 2 + F.col("again") + 1).alias("ord"), "value")
    head = s.groupBy().agg(F.lit("pedigrees.csv").alias("file"), F.lit(0).alias("ord"), F.lit("Line,Female Parent,Male Parent").alias("value"))
    return _lines(body, head)


def variant_set_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(call set pages, variant pages, matrix pages) as lines of JSON.

    Every tenth sample shares its name with its neighbour; variants of one size have no position; tokens mix both separators.
    """
    s = binding.table(spark, sf, "supplier").select(
        F.expr("s_suppkey div 10").alias("page"), F.col("s_suppkey").alias("k"),
        F.struct(
            F.expr("concat('cs', s_suppkey)").alias("callSetDbId"), F.expr("if(s_suppkey % 10 < 2, concat('name', s_suppkey div 10), concat('s', s_suppkey))").alias("callSetName"),
            F.expr("concat('db', s_suppkey)").alias("sampleDbId"),
        ).alias("x"),
    )
    v = binding.table(spark, sf, "part").select(
        F.expr("p_partkey div 100").alias("page"), F.col("p_partkey").alias("k"),
        F.struct(
            F.expr("concat('v', p_partkey)").alias("variantDbId"), F.expr("if(p_size = 8, array('.', ''), array('.', concat('m', p_partkey)))").alias("variantNames"),
            F.expr("if(p_size = 9, null, concat('Gm', 1 + p_partkey % 20))").alias("referenceName"), F.expr("(p_partkey div 20 + 1) * 30000 - 1").alias("start"),
            F.expr("if(p_size = 10, null, 'A')").alias("referenceBases"), F.expr("if(p_size = 10, null, array('C', ''))").alias("alternateBases"),
        ).alias("x"),
    )

    def listed(rows: DataFrame, prefix: str) -> DataFrame:
        data = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("data"))
        return data.select(F.concat(F.lit(prefix), F.col("page").cast("string")).alias("file"), F.to_json(F.struct(F.struct("data").alias("result"))).alias("value"))

    token = lambda c: F.when(c.isNull() | (c["a1"].isNull() & c["a2"].isNull()), F.lit(None)).when(c["a2"].isNull(), F.concat(c["a1"].cast("string"), F.lit("/N"))).when(
        c["a1"] == c["a2"], c["a1"].cast("string")
    ).otherwise(F.concat(c["a1"].cast("string"), F.when(c["s"] % 2 == 1, "|").otherwise("/"), c["a2"].cast("string")))
    matrix = F.array(F.struct(F.lit("GT").alias("dataMatrixAbbreviation"), F.transform("rows", lambda r: F.transform(r["c"], token)).alias("dataMatrix")))
    result = F.struct(
        F.transform("names", lambda n: F.concat(F.lit("cs"), F.substring(n, F.lit(2), F.length(n)))).alias("callSetDbIds"),
        F.transform("rows", lambda r: F.concat(F.lit("v"), r["p"].cast("string"))).alias("variantDbIds"),
        F.lit("N").alias("unknownString"), matrix.alias("dataMatrices"),
    )
    pages = page_cells(spark, sf).select(
        F.concat(F.lit("allelematrix"), F.col("b").cast("string"), F.lit("_"), F.col("page").cast("string")).alias("file"), F.to_json(F.struct(result.alias("result"))).alias("value")
    )
    return listed(s, "callsets"), listed(v, "variants"), pages
