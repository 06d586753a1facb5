"""Registered queries over text inputs: lines are made from the bound tables, parsed, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from introspark.functions.chrom import CROPS, canonical_chrom, chrom_order
from introspark.functions.text import position
from introspark.operators.dataset import Dataset, absent_samples, duplicate_ids, extra_samples, map_warnings, overlay_map, with_synthetic_parents
from introspark.sources import grids, lines, manifest, vcf
from workload import binding, texts
from workload.queries import register

# every cell of a batch file: the batch's samples at each of its markers
GRID = """
    grid AS (SELECT k.p, k.b, s_suppkey AS s, a1, a2
             FROM (SELECT DISTINCT p, s // 4 AS b FROM progeny_calls) k JOIN supplier ON s_suppkey // 4 = k.b
                  LEFT JOIN progeny_calls c ON c.p = k.p AND c.s = s_suppkey)"""

NAME = """CASE WHEN p % 11 <> 0 THEN 'm' || p ELSE (CASE p % 3 WHEN 0 THEN 'Chr' || (1 + p % 20) WHEN 1 THEN 'Gm' || lpad(CAST(1 + p % 20 AS VARCHAR), 2, '0')
          ELSE 'glyma.Wm82.gnm4.Gm' || lpad(CAST(1 + p % 20 AS VARCHAR), 2, '0') END) || '_' || ((p // 20 + 1) * 30000) END"""
CHROM = "'Gm' || lpad(CAST(1 + p % 20 AS VARCHAR), 2, '0')"


@register("s1_vcf_calls", f", {GRID} SELECT {NAME} AS marker_id, 's' || s AS sample_id, CAST(a1 AS INT) AS a1, CAST(a2 AS INT) AS a2 FROM grid")
def s1_vcf_calls(spark, sf):
    return vcf.parse_vcf(texts.vcf_lines(spark, sf)).calls


@register("s4_vcf_markers", f", {GRID} SELECT DISTINCT {NAME} AS marker_id, {CHROM} AS chrom, (p // 20 + 1) * 30000 AS pos_bp, 'A/C/G' AS alleles FROM grid")
def s4_vcf_markers(spark, sf):
    found = vcf.parse_vcf(texts.vcf_lines(spark, sf)).markers
    return found.select("marker_id", "chrom", "pos_bp", F.array_join("alleles", "/").alias("alleles")).distinct()


@register("s2_vcf_violations", f""", {GRID}, n AS (SELECT b, count(*) AS size FROM (SELECT s_suppkey // 4 AS b FROM supplier) GROUP BY b),
    rec AS (SELECT DISTINCT p, b FROM grid)
    SELECT kind, count(*) AS n FROM (
        SELECT 'invalid position' AS kind FROM rec WHERE p % 101 = 9
        UNION ALL SELECT 'invalid GT' FROM rec JOIN n USING (b) WHERE p % 101 <> 9 AND p % 97 = 5 AND size >= 2
        UNION ALL SELECT 'allele index beyond the record''s alleles' FROM rec JOIN n USING (b) WHERE p % 101 <> 9 AND p % 89 = 7 AND size >= 3)
    GROUP BY kind""")
def s2_vcf_violations(spark, sf):
    return vcf.parse_vcf(texts.vcf_lines(spark, sf, broken=True)).violations.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("p10_vcf_manifest_columns", f", {GRID} SELECT {NAME} AS marker_id, 's' || s AS sample_id, CAST(a1 AS INT) AS a1, CAST(a2 AS INT) AS a2 FROM grid WHERE 's' || s IN (SELECT sample_id FROM progeny WHERE family_id IS NOT NULL)")
def p10_vcf_manifest_columns(spark, sf):
    wanted = binding.dataset(spark, sf).progeny.filter("family_id is not null")
    return vcf.parse_vcf(texts.vcf_lines(spark, sf), manifest=wanted).calls


SYMBOL = "CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN substr('ACG', CAST({f}(a1, a2) AS INT) + 1, 1) END"


def _symbols(parsed):
    at = lambda c: F.try_element_at("alleles", F.col(c) + 1)
    return parsed.calls.join(parsed.markers.select("marker_id", "alleles"), "marker_id").select(
        "marker_id", "sample_id", at("a1").alias("first_allele"), at("a2").alias("second_allele")
    )


SYMBOLS_SQL = f""", {GRID} SELECT 'm' || p || 'b' || b AS marker_id, 's' || s AS sample_id, {SYMBOL.format(f='least')} AS first_allele,
    {SYMBOL.format(f='greatest')} AS second_allele FROM grid"""


@register("s5_hapmap_calls", SYMBOLS_SQL)
def s5_hapmap_calls(spark, sf):
    return _symbols(grids.parse_hapmap(texts.hapmap_lines(spark, sf)))


@register("s5_hapmap_markers", f""", {GRID} SELECT 'm' || p || 'b' || b AS marker_id, {CHROM} AS chrom, (p // 20 + 1) * 30000 AS pos_bp,
    coalesce(string_agg(DISTINCT a, '/' ORDER BY a), '') AS alleles FROM (
        SELECT p, b, {SYMBOL.format(f='least')} AS a FROM grid UNION ALL SELECT p, b, {SYMBOL.format(f='greatest')} FROM grid) GROUP BY p, b""")
def s5_hapmap_markers(spark, sf):
    found = grids.parse_hapmap(texts.hapmap_lines(spark, sf)).markers
    return found.select("marker_id", "chrom", "pos_bp", F.array_join("alleles", "/").alias("alleles"))


@register("s6_wide_nucleotide_calls", SYMBOLS_SQL)
def s6_wide_nucleotide_calls(spark, sf):
    return _symbols(grids.parse_wide(texts.wide_lines(spark, sf)))


CODED = "a1 IS NULL OR a2 IS NULL OR a2 = 2"


@register("p7_wide_coded_calls", f""", {GRID} SELECT 'm' || p || 'b' || b AS marker_id, 's' || s AS sample_id,
    CASE WHEN {CODED} THEN NULL WHEN a1 = p % 2 AND a2 = p % 2 THEN 0 WHEN a1 = a2 THEN 1 ELSE 0 END AS a1,
    CASE WHEN {CODED} THEN NULL WHEN a1 = p % 2 AND a2 = p % 2 THEN 0 ELSE 1 END AS a2 FROM grid""")
def p7_wide_coded_calls(spark, sf):
    return grids.parse_wide(texts.wide_lines(spark, sf, "coded"), coding="auto").calls


@register("p8_detect_coding", """
    SELECT * FROM (VALUES ('coded', true), ('nucleotide', false)) t(tokens, coded) WHERE (SELECT count(*) FROM progeny_calls) > 0""")
def p8_detect_coding(spark, sf):
    found = [
        grids.detect_coding(grids.wide_tokens(texts.wide_lines(spark, sf, t)), []).select(F.lit(t).alias("tokens"), "coded") for t in ("coded", "nucleotide")
    ]
    return found[0].unionByName(found[1])


@register("p5_wide_profile_tokens", f""", {GRID} SELECT 'm' || p || 'b' || b AS marker_id, 's' || s AS sample_id,
    CASE WHEN NOT ({CODED}) THEN CASE WHEN least(a1, a2) = 0 THEN 'X' ELSE 'Y' END END AS first_allele,
    CASE WHEN NOT ({CODED}) THEN CASE WHEN greatest(a1, a2) = 0 THEN 'X' ELSE 'Y' END END AS second_allele FROM grid""")
def p5_wide_profile_tokens(spark, sf):
    return _symbols(grids.parse_wide(texts.wide_lines(spark, sf, "kasp"), profile="kasp"))


HET = f"""
    hom AS (SELECT p, b, count(DISTINCT a1) FILTER (NOT ({CODED}) AND a1 = a2) AS n, count(*) FILTER (NOT ({CODED}) AND a1 <> a2) AS n_het FROM grid GROUP BY p, b)"""


@register("p6_marker_heterozygotes", f""", {GRID}, {HET} SELECT 'm' || p || 'b' || b AS marker_id, 's' || s AS sample_id,
    CASE WHEN NOT ({CODED}) THEN substr('ACG', CAST(least(a1, a2) AS INT) + 1, 1) END AS first_allele,
    CASE WHEN NOT ({CODED}) THEN substr('ACG', CAST(greatest(a1, a2) AS INT) + 1, 1) END AS second_allele
    FROM grid JOIN hom USING (p, b) WHERE n_het = 0 OR n = 2""")
def p6_marker_heterozygotes(spark, sf):
    return _symbols(grids.parse_wide(texts.wide_lines(spark, sf, "het"), coding="nucleotide", profile="soybase-report"))


@register("p6_unresolved_heterozygotes", f""", {GRID}, {HET} SELECT 'm' || p || 'b' || b || ' H' AS detail FROM hom WHERE n_het > 0 AND n <> 2""")
def p6_unresolved_heterozygotes(spark, sf):
    return grids.parse_wide(texts.wide_lines(spark, sf, "het"), coding="nucleotide", profile="soybase-report").violations.select("detail")


# --- names and positions ----------------------------------------------------------------------------------------------


def _crop_sql() -> str:
    rows = []
    for c in CROPS.values():
        listed = ", ".join(f"'{x}'" for x in c.chromosomes)
        rows.append(f"SELECT '{c.crop_id}' AS crop, p_partkey AS p, [{listed}][CAST(p_partkey % {len(c.chromosomes)} AS INT) + 1] AS chrom FROM part")
    return " UNION ALL ".join(rows)


@register("p1_chromosome_names", _crop_sql())
def p1_chromosome_names(spark, sf):
    """Every crop's canonical names in several spellings: as written, upper case, padded with blanks."""
    parts = binding.table(spark, sf, "part").select(F.col("p_partkey").alias("p"))
    out = None
    for c in CROPS.values():
        names = F.array(*[F.lit(x) for x in c.chromosomes])
        name = F.element_at(names, (F.col("p") % len(c.chromosomes) + 1).cast("int"))
        spelled = F.when(F.col("p") % 3 == 0, name).when(F.col("p") % 3 == 1, F.upper(name)).otherwise(F.concat(F.lit("\t "), F.lower(name), F.lit(" ")))
        one = parts.select("p", spelled.alias("name")).select(F.lit(c.crop_id).alias("crop"), "p", canonical_chrom(F.col("name"), c).alias("chrom"))
        out = one if out is None else out.unionByName(one)
    return out


@register("p2_chromosome_order", """
    SELECT name, row_number() OVER (ORDER BY CASE WHEN name LIKE 'Gm%' THEN CAST(substr(name, 3) AS INT) ELSE 99 END,
                                    regexp_extract(name, '^([^0-9]*)', 1), CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS INT)) AS place
    FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'Gm' || lpad(CAST(1 + p_partkey % 20 AS VARCHAR), 2, '0') ELSE 'scaffold_' || (p_size * 7 + p_partkey % 3) END AS name FROM part)""")
def p2_chromosome_order(spark, sf):
    from introspark.operators.rank import positions

    names = binding.table(spark, sf, "part").selectExpr(
        "if(p_size % 2 = 0, concat('Gm', lpad(cast(1 + p_partkey % 20 as string), 2, '0')), concat('scaffold_', p_size * 7 + p_partkey % 3)) as name"
    ).distinct().withColumn("k", chrom_order(F.col("name")))
    return positions(names, [F.asc("k")], "place").select("name", "place")


@register("p3_positions", """
    SELECT p_partkey AS p, CASE p_size % 8 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE p_partkey * 100 END AS pos_bp,
           CASE WHEN p_size % 8 IN (0, 7) THEN p_partkey * 100 END AS vcf_pos FROM part""")
def p3_positions(spark, sf):
    text = F.expr("""case p_size % 8 when 0 then cast(p_partkey * 100 as string) when 1 then concat('+', p_partkey * 100) when 2 then concat(p_partkey, 'E+2')
                     when 3 then concat(p_partkey * 100, '.5') when 4 then concat('-', p_partkey * 100 + 1) when 5 then concat(p_partkey * 100, '.0')
                     when 6 then concat(p_partkey, '_000') else concat(' ', p_partkey * 100, ' ') end""")
    return binding.table(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), position(text).alias("pos_bp"), position(text, digits_only=True).alias("vcf_pos")
    )


# --- manifest, map, assembly of the dataset -----------------------------------------------------------------------------


@register("s9_manifest", "SELECT sample_id, line_name, role, generation, family_id, notes FROM samples")
def s9_manifest(spark, sf):
    return manifest.parse_samples(texts.manifest_lines(spark, sf))[0].drop("sample_ord")


@register("s9_manifest_violations", """
    SELECT kind, count(*) AS n FROM (
        SELECT 'duplicate sample_id' AS kind FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)
        UNION ALL SELECT 'unknown role' FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT 'exactly one donor_parent required') GROUP BY kind""")
def s9_manifest_violations(spark, sf):
    rows = _broken_manifest(spark, sf)
    return manifest.sample_violations(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _broken_manifest(spark, sf):
    supplier = binding.table(spark, sf, "supplier")
    first = supplier.filter("s_acctbal >= 0").agg(F.min("s_suppkey").alias("k")).scalar()
    role = F.when(F.col("s_acctbal") < 0, "parent").when(F.col("s_suppkey") == first, "recurrent_parent").otherwise("progeny")
    return supplier.select(F.expr("concat('n', s_nationkey)").alias("sample_id"), role.alias("role"))


MAPPED = """
    mapped AS (SELECT 'm' || p_partkey AS marker_id, 'Gm' || lpad(CAST(1 + p_partkey % 20 AS VARCHAR), 2, '0') AS chrom, p_partkey AS p,
                      (p_partkey // 20 + 1) * 30000 + CASE WHEN p_size = 7 THEN 500 ELSE 0 END AS pos_bp,
                      CASE WHEN p_size IN (11, 12) THEN NULL ELSE (p_partkey // 20 + 1) * CAST(0.075 AS DOUBLE) END AS cm FROM part WHERE p_size <> 9)"""


@register("s10_marker_map", f", {MAPPED} SELECT marker_id, chrom, pos_bp, cm FROM mapped")
def s10_marker_map(spark, sf):
    return manifest.parse_marker_map(texts.map_lines(spark, sf))[0].drop("file_ord")


@register("j1_map_overlay", f""", {MAPPED} SELECT marker_id, m.chrom, coalesce(d.pos_bp, m.pos_bp) AS pos_bp, d.cm AS cm, d.marker_id IS NOT NULL AS in_map
    FROM markers m LEFT JOIN mapped d USING (marker_id)""")
def j1_map_overlay(spark, sf):
    overlaid = overlay_map(binding.markers(spark, sf), manifest.parse_marker_map(texts.map_lines(spark, sf))[0])
    return overlaid.select("marker_id", "chrom", "pos_bp", "cm", "in_map")


@register("t4_map_warnings", f""", {MAPPED}
    SELECT 'moved' AS kind, d.marker_id, d.pos_bp AS n FROM mapped d JOIN markers m USING (marker_id, p) WHERE d.pos_bp <> m.pos_bp
    UNION ALL SELECT 'not on the map', NULL, n FROM (SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT p FROM mapped)) WHERE n > 0""")
def t4_map_warnings(spark, sf):
    overlaid = overlay_map(binding.markers(spark, sf), manifest.parse_marker_map(texts.map_lines(spark, sf))[0])
    return map_warnings(overlaid).select("kind", "marker_id", "n")


@register("j2_manifest_alignment", """
    SELECT side, sample_id FROM (
        SELECT 'absent' AS side, sample_id FROM samples WHERE sample_id NOT IN (SELECT DISTINCT sample_id FROM progeny_calls)
        UNION ALL SELECT DISTINCT 'extra', c.sample_id FROM progeny_calls c JOIN samples USING (sample_id) WHERE family_id IS NULL)""")
def j2_manifest_alignment(spark, sf):
    samples = binding.samples(spark, sf)
    in_file = binding.progeny_calls(spark, sf).select("sample_id").distinct()
    absent = absent_samples(in_file, samples).select(F.lit("absent").alias("side"), "sample_id")
    return absent.unionByName(extra_samples(in_file, samples.filter("family_id is not null")).select(F.lit("extra").alias("side"), "sample_id"))


@register("u1_synthetic_parents", """
    SELECT marker_id, 's0' AS sample_id, 0 AS a1, 0 AS a2 FROM markers UNION ALL SELECT marker_id, 's1', 1, 1 FROM markers""")
def u1_synthetic_parents(spark, sf):
    calls = binding.progeny_calls(spark, sf)
    data = Dataset(binding.markers(spark, sf), binding.samples(spark, sf), calls, coded=True)
    return with_synthetic_parents(data, calls.select("sample_id").distinct()).calls.filter("sample_id in ('s0', 's1')")


@register("a28_duplicate_ids", """
    SELECT 'marker_id' AS kind, p_name AS id, count(*) AS n_rows FROM part GROUP BY p_name HAVING count(*) > 1
    UNION ALL SELECT 'sample_id', 'n' || s_nationkey, count(*) FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""")
def a28_duplicate_ids(spark, sf):
    markers = binding.table(spark, sf, "part").selectExpr("p_name as marker_id")
    samples = binding.table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) as sample_id")
    return duplicate_ids(Dataset(markers, samples, binding.progeny_calls(spark, sf)))


@register("s19_encoding_audit", """
    SELECT lang AS file, count(*) FILTER (source = (SELECT min(source) FROM documents)) AS n_lines FROM documents
    GROUP BY lang HAVING count(*) FILTER (source = (SELECT min(source) FROM documents)) > 0""")
def s19_encoding_audit(spark, sf):
    """Documents as lines; those of one source get a stray Latin-1 byte appended."""
    docs = binding.table(spark, sf, "documents")
    bad = docs.agg(F.min("source").alias("s")).scalar()
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("E9"))).cast("string")
    rows = docs.select(F.col("lang").alias("file"), F.col("doc_id").alias("ord"), F.when(F.col("source") == bad, broken).otherwise(F.col("text")).alias("value"))
    return lines.encoding_audit(rows).select("file", "n_lines")


@register("p20_blank_rows", """
    SELECT CAST(count(*) FILTER (p_size % 4 = 0 OR p_size % 4 = 3) AS BIGINT) AS n_rows FROM part""")
def p20_blank_rows(spark, sf):
    text = F.expr("case p_size % 4 when 0 then concat(p_name, ',x') when 1 then ' \t ' when 2 then ', ,\t' else p_name end")
    rows = binding.table(spark, sf, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("ord"), text.alias("value"))
    return lines.headed(rows, F.lit(False), ",").agg(F.count(F.lit(1)).alias("n_rows"))
