"""Chromosome names: spelling -> canonical name, order, and reference lengths, per crop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from introspark.functions.text import strip
from introspark.schema import SOYBEAN_LENGTHS


@dataclass(frozen=True)
class Crop:
    """Canonical chromosomes in order, the key of each, and the spelling pattern whose groups spell a key."""

    crop_id: str
    chromosomes: tuple[str, ...]
    keys: tuple[str, ...]
    pattern: str
    groups: int = 1


def _numbered(template: str, n: int) -> tuple[str, ...]:
    return tuple(template.format(i) for i in range(1, n + 1))


def _subgenomes(template: str, letters: str, n: int = 7) -> tuple[str, ...]:
    return tuple(template.format(f"{i}{g}") for i in range(1, n + 1) for g in letters)


def _numeric(crop_id: str, template: str, n: int, pattern: str, groups: int = 1) -> Crop:
    return Crop(crop_id, _numbered(template, n), _numbered("{}", n), pattern, groups)


# The accepted spellings of each supported crop.
CROPS: dict[str, Crop] = {
    c.crop_id: c
    for c in (
        _numeric("soybean", "Gm{:02d}", 20,
                 r"^(?:glyma\.wm82\.gnm[0-9]+\.(?:gm|chr)|glymachr|gm|chr|chromosome|lg)?[_\s-]?0*([1-9]|1[0-9]|20)$"),
        _numeric("maize", "chr{}", 10, r"^(?:chr|chromosome)?[_\s-]?0*([1-9]|10)$"),
        _numeric("rice", "Chr{}", 12, r"^(?:chr|chromosome)?[_\s-]?0*([1-9]|1[0-2])$"),
        _numeric("sorghum", "Chr{:02d}", 10, r"^(?:chr|chromosome)?[_\s-]?0*([1-9]|10)$"),
        Crop("wheat", _subgenomes("Chr{}", "ABD"), _subgenomes("{}", "ABD"),
             r"^(?:chr|chromosome)?[_\s-]?0*([1-7])[_-]?([ABD])$", 2),
        Crop("barley", _subgenomes("chr{}", "H"), _subgenomes("{}", "H"),
             r"^(?:chr|chromosome)?[_\s-]?0*([1-7])[_-]?(H)$", 2),
        Crop("oat", _subgenomes("chr{}", "ACD"), _subgenomes("{}", "ACD"),
             r"^(?:chr|chromosome)?[_\s-]?0*([1-7])[_-]?([ACD])$", 2),
        _numeric("common-bean", "Chr{:02d}", 11, r"^(?:chr|pv|chromosome)?[_\s-]?0*([1-9]|1[01])$"),
        Crop("cotton", _numbered("A{:02d}", 13) + _numbered("D{:02d}", 13), _numbered("A{}", 13) + _numbered("D{}", 13),
             r"^(?:chr|chromosome)?[_\s-]?([AD])[_-]?0*([1-9]|1[0-3])$", 2),
        _numeric("cowpea", "Vu{:02d}", 11,
                 r"^(?:vu|chr|chromosome)?[_\s-]?(?:0*([1-9]|1[01])|0*(1)\(old4\)|0*(2)\(old7\)|0*(3)\(old3\)"
                 r"|0*(4)\(old11\)|0*(5)\(old1\)|0*(6)\(old6\)|0*(7)\(old2\)|0*(8)\(old5\)|0*(9)\(old8\)"
                 r"|0*(10)\(old10\)|0*(11)\(old9\))$", 12),
        Crop("pea", ("chr1LG6", "chr2LG1", "chr3LG5", "chr4LG4", "chr5LG3", "chr6LG2", "chr7LG7"), _numbered("{}", 7),
             r"^(?:(?:chr|chromosome)[_\s-]?0*([1-7])|(?:chr|chromosome)?[_\s-]?(?:0*(1)LG6|0*(2)LG1|0*(3)LG5"
             r"|0*(4)LG4|0*(5)LG3|0*(6)LG2|0*(7)LG7))$", 8),
        _numeric("peanut", "Arahy.{:02d}", 20,
                 r"^(?:(?:arahy\.tifrunner\.gnm[12]\.)?(?:arahy\.|chr)|chromosome)?[_\s-]?0*([1-9]|1[0-9]|20)$"),
        _numeric("sunflower", "{}", 17, r"^(?:ha412hochr|hanxrqchr|chr|chromosome)?[_\s-]?0*([1-9]|1[0-7])$"),
    )
}
SOYBEAN = CROPS["soybean"]


def crop(crop_id: str | None) -> Crop:
    """The crop for an id; unset means soybean."""
    found = CROPS.get(crop_id or "soybean")
    if found is None:
        raise ValueError(f"unknown crop {crop_id!r}; known crops: {', '.join(CROPS)}")
    return found


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def canonical_chrom(name: Column, scheme: Crop = SOYBEAN) -> Column:
    """Canonical name for every accepted spelling; any other name is kept, trimmed."""
    raw = strip(name)
    spelled = F.concat_ws("", *[F.regexp_extract(raw, "(?i)" + scheme.pattern, g) for g in range(1, scheme.groups + 1)])
    key = F.regexp_replace(F.upper(spelled), "(?<![0-9])0+(?=[0-9])", "")
    lookup = _literal_map(zip(scheme.keys, scheme.chromosomes, strict=True))
    return F.coalesce(F.try_element_at(lookup, key), raw)


def chrom_order(canonical: Column, scheme: Crop = SOYBEAN) -> Column:
    """Sort key: crop order first, then every other name with its digit runs compared as numbers.

    Each digit run is left-padded to 20 digits behind a control character, so text still sorts before numbers.
    """
    ordinal = _literal_map((c, i) for i, c in enumerate(scheme.chromosomes))
    rank = F.coalesce(F.try_element_at(ordinal, canonical), F.lit(len(scheme.chromosomes)))
    padded = F.regexp_replace(canonical, "([0-9]+)", "\u0001" + "0" * 20 + "$1")
    natural = F.regexp_replace(padded, "[0-9]*([0-9]{20})(?![0-9])", "$1")
    other = F.when(rank == len(scheme.chromosomes), natural).otherwise(F.lit(""))
    return F.struct(rank.alias("rank"), other.alias("natural"))


def assembly_length(canonical: Column, assembly: str, scheme: Crop = SOYBEAN) -> Column:
    """Reference length of a chromosome; NULL for every crop but soybean and for an assembly without a table."""
    if scheme is not SOYBEAN or assembly not in SOYBEAN_LENGTHS:
        return F.lit(None).cast("bigint")
    table = _literal_map((c, int(n)) for c, n in zip(SOYBEAN.chromosomes, SOYBEAN_LENGTHS[assembly], strict=True))
    return F.try_element_at(table, canonical).cast("bigint")
