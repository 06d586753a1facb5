"""Generation labels and their Mendelian expectations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two label grammars.
_BACKCROSS = r"(?i)^\s*(?:BC([0-9]+))?\s*(?:[FS]([0-9]+))?\s*$"
_DOSE = r"(?:[^/*\s]+\*([0-9]+)|([0-9]+)\*[^/*\s]+)"
_PEDIGREE_LEFT = r"^\s*" + _DOSE + r"/[^/*\s]+\s*$"
_PEDIGREE_RIGHT = r"^\s*[^/*\s]+/" + _DOSE + r"\s*$"


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def parse_generation(label: Column) -> Column:
    """STRUCT(n_backcross, n_filial, filial_known), or NULL when the label cannot be read."""
    bc_text = F.regexp_extract(label, _BACKCROSS, 1)
    filial_text = F.regexp_extract(label, _BACKCROSS, 2)
    standard = label.rlike(_BACKCROSS) & ((bc_text != "") | (filial_text != ""))
    bc = F.coalesce(_number(bc_text), F.lit(0))
    # S counts selfings and F counts filial generations, so S1 is F2
    selfed = F.upper(label).contains("S") & ~F.upper(label).contains("F")
    filial = F.coalesce(_number(filial_text) + F.when(selfed, 1).otherwise(0), F.lit(1))
    dose = F.coalesce(
        *[_number(F.regexp_extract(label, p, g)) for p in (_PEDIGREE_LEFT, _PEDIGREE_RIGHT) for g in (1, 2)]
    )

    def result(n_backcross: Column, n_filial: Column, known: bool) -> Column:
        return F.struct(
            n_backcross.cast("int").alias("n_backcross"),
            n_filial.cast("int").alias("n_filial"),
            F.lit(known).alias("filial_known"),
        )

    return (
        F.when(standard & (filial >= 1), result(bc, filial, True))
        .when(~standard & (dose >= 1), result(dose - 1, F.lit(1), False))
    )


def expected_fractions(generation: Column) -> Column:
    """STRUCT(rpp, hom_rp, het, hom_donor) expected with no selection and unlinked loci."""
    after_backcross = F.pow(F.lit(0.5), generation["n_backcross"])
    selfings = F.greatest(generation["n_filial"] - 1, F.lit(0))
    het = after_backcross * F.pow(F.lit(0.5), selfings)
    hom_donor = (after_backcross - het) / 2
    hom_rp = F.lit(1.0) - het - hom_donor
    return F.when(
        generation.isNotNull(),
        F.struct((hom_rp + het / 2).alias("rpp"), hom_rp.alias("hom_rp"), het.alias("het"), hom_donor.alias("hom_donor")),
    )


def expected_rpp(generation: Column) -> Column:
    return F.lit(1.0) - F.pow(F.lit(0.5), generation["n_backcross"] + 1)
