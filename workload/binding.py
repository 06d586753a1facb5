"""Genotype tables derived from the driver's part, supplier and lineitem tables.

* markers <- part: one marker per part, 20 chromosomes, 30 kb apart.
* samples <- supplier: key 0 is the recurrent parent, key 1 the donor, all others progeny.
* calls <- the parents' two calls per part, and one progeny call per (part, supplier) pair that occurs in
  lineitem. A pair without a line is a missing call. Every table grows linearly with its source: nothing
  here multiplies parts by suppliers.

The same definitions are written as SQL in ``workload.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.config import Criteria, criteria_from_dict
from introspark.operators.common import computed_once
from introspark.operators.dataset import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('m', p_partkey) as marker_id",
        "concat('Gm', lpad(cast(1 + p_partkey % 20 as string), 2, '0')) as chrom",
        "(p_partkey div 20 + 1) * 30000 as pos_bp",
        "(p_partkey div 20 + 1) * 0.075D as cm",
        "p_partkey as file_ord",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey) as sample_id",
        "s_name as line_name",
        "case s_suppkey when 0 then 'recurrent_parent' when 1 then 'donor_parent' else if(s_suppkey % 5 = 0, 'candidate', 'progeny') end as role",
        """case when s_suppkey < 2 then null when s_suppkey % 16 = 7 then 'line' when s_suppkey % 16 = 15 then null
           else element_at(array('BC1F1', 'BC2F1', 'BC2F2', 'RP*3/D', 'BC1F1', 'BC2S1', 'BC3F1', 'F2'), cast(s_suppkey % 8 as int) + 1) end as generation""",
        "case when s_suppkey < 2 or s_nationkey = 24 then null else concat('F', s_nationkey) end as family_id",
        "if(s_acctbal < 0, 'overdrawn, see ledger', null) as notes",
        "s_suppkey as sample_ord",
    )


def parent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as p", "cast(p_partkey % 2 as int) as r")
    both = p.selectExpr(
        "p",
        """inline(array(
            named_struct('s', 0L, 'a1', case when p % 61 = 5 then null when p % 59 = 11 then 0 else r end,
                                  'a2', case when p % 61 = 5 then null when p % 59 = 11 then 1 else r end),
            named_struct('s', 1L, 'a1', case when p % 53 = 7 then null when p % 67 = 13 then 0 when p % 17 = 3 then r else 1 - r end,
                                  'a2', case when p % 53 = 7 then null when p % 67 = 13 then 1 when p % 17 = 3 then r else 1 - r end)))""",
    )
    return both.selectExpr("concat('m', p) as marker_id", "concat('s', s) as sample_id", "a1", "a2")


#: What a line says about its call, and the haplotype of a marker's block in a sample.
_FACTS = {"dropped": "l_returnflag = 'R' and l_linenumber = 7", "half": "l_returnflag = 'A' and l_linenumber = 1 and l_quantity <= 2", "odd": "l_quantity = 50"}
_SOURCE = "if(s % 10 = 4, s - 1, s)"
_HAPLOTYPE = "((p % 20) * 7 + ((p div 20) div 10) * 13 + g * 29 + (g div 7) * 3) % 16"


def progeny_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per (part, supplier) pair of lineitem; the aggregate reads five of its columns.

    Neighbouring markers share a haplotype block, samples s%10 = 4 repeat the haplotypes of their
    predecessor, and line details add missing, half-missing and non-parental calls.
    """
    cells = (
        table(spark, sf_dir, "lineitem").filter("l_suppkey >= 2")
        .groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
        .agg(*[F.bool_or(F.expr(said)).alias(name) for name, said in _FACTS.items()])
    )
    state = F.expr("case when s % 9 = 0 and odd then 'X' when h < 4 then 'H' when h = 4 and s % 4 = 2 then 'B' else 'A' end")
    a1 = "cast(case when dropped then null when state = 'H' then 0 when state = 'B' then 1 - p % 2 else p % 2 end as int)"
    a2 = "cast(case when dropped or half then null when state = 'X' then 2 when state = 'H' then 1 when state = 'B' then 1 - p % 2 else p % 2 end as int)"
    # a filter on the alleles would repeat all of this, in a method too long for the JVM to compile
    stated = computed_once(cells.withColumn("g", F.expr(_SOURCE)).withColumn("h", F.expr(_HAPLOTYPE)), ["p", "s", "dropped", "half"], state=state)
    called = computed_once(stated, ["p", "s"], a1=F.expr(a1), a2=F.expr(a2))
    return called.selectExpr("concat('m', p) as marker_id", "concat('s', s) as sample_id", "a1", "a2")


def batch_calls(spark: SparkSession, sf_dir: str, batch: int, page: int | None = None) -> DataFrame:
    """(b, p, c0, c1, ...): the calls of ``progeny_calls`` per batch of neighbouring samples and marker: STRUCT(s, a1, a2), or NULL.

    A line gives its call a few bits (there is one, dropped, half, third allele, heterozygous, donor), and the bits of a
    batch's lines at a marker meet by OR, in one shuffle. With ``page`` that shuffle is by batch and page of so many markers, a
    column more: what is then gathered per page is not shuffled again.
    """
    lines = table(spark, sf_dir, "lineitem").filter("l_suppkey >= 2").selectExpr("l_partkey as p", "l_suppkey as s", *[f"{said} as {name}" for name, said in _FACTS.items()])
    lines = lines.withColumn("g", F.expr(_SOURCE)).withColumn("h", F.expr(_HAPLOTYPE))
    bits = """1 | if(dropped, 2, 0) | if(half, 4, 0) | if(s % 9 = 0 and odd, 8, 0) | case when h < 4 then 16 when h = 4 and s % 4 = 2 then 32 else 0 end"""
    met = lines.selectExpr(f"s div {batch} as b", "p", f"shiftleft({bits}, cast(s % {batch} as int) * 6) as bits")
    keys = ["b", "p"]
    if page is not None:
        keys = ["b", "page", "p"]
        met = met.withColumn("page", F.expr(f"p div {page}")).repartition("b", "page")
    met = met.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
    # the two alleles by the parity of the marker and the bits of a call: most places are of bits that do not occur together
    sides = [_sides(x, r) for r in range(2) for x in range(64)]
    first, second = (F.array(*[F.lit(side[k]).cast("int") for side in sides]) for k in range(2))
    places = computed_once(met, keys, **{f"x{k}": F.expr(f"cast(p % 2 as int) * 64 + (shiftright(bits, {6 * k}) & 63)") for k in range(batch)})
    return computed_once(places, keys, **{
        f"c{k}": F.when(F.expr(f"x{k} & 1 = 1"), F.struct(F.expr(f"b * {batch} + {k}").alias("s"), F.get(first, f"x{k}").alias("a1"), F.get(second, f"x{k}").alias("a2")))
        for k in range(batch)
    })


def _sides(bits: int, r: int) -> tuple[int | None, int | None]:
    """The alleles that the bits of a call stand for, where the recurrent parent has allele ``r``."""
    dropped, half, third, het, donor = (bits & 1 << k for k in range(1, 6))
    base = r if third else 0 if het else 1 - r if donor else r
    other = 2 if third else 1 if het else base
    return None if dropped else base, None if dropped or half else other


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    parents = parent_calls(spark, sf_dir)
    return Dataset(markers(spark, sf_dir), samples(spark, sf_dir), parents.unionByName(progeny_calls(spark, sf_dir)), parents=parents)


# The loci of the bound dataset; all resolve from the smallest scale factor on.
CRITERIA: dict = {
    "name": "bound tables",
    "targets": [
        {"id": "T1", "region": "Gm05:60,000-900,000", "rule": "any", "flank_left": 60000},
        {"id": "T2", "chrom": "12", "start_bp": 90000, "end_bp": 1500000, "rule": "run", "min_run": 2, "anchor_bp": 180000},
        {"id": "T3", "left_marker": "m126", "right_marker": "m46"},
    ],
    "avoid": [
        {"id": "V1", "region": "Gm10:60000-300000"},
        {"id": "V2", "marker_id": "m45", "allow_het": True},
    ],
    # absent pairs are missing calls, so the missing rate is high by construction
    "filters": {"max_missing_rate": 0.98, "unknown_target_is": "pass", "max_hom_donor_rate_bcf1": 0.08},
    "background": {"map_unit": "bp"},
    "flank_unit": "bp",
    "flank_window": 200000,
}


def criteria(**changes) -> Criteria:
    return criteria_from_dict({**CRITERIA, **changes})
