"""Genotype cells: text -> allele pair. All functions are column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from introspark.functions.text import strip
from introspark.schema import CODED_MISSING, HAPMAP_EXTRA_MISSING, NUCLEOTIDE_MISSING

# Two-base ambiguity codes.
AMBIGUITY = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}

# Genotype index grammar.
GT = r"^(\.|0|[1-9][0-9]*)(?:[/|](\.|0|[1-9][0-9]*))?$"
HIGHEST_ALLELE = 127


@dataclass(frozen=True)
class Profile:
    """Vocabulary of one genotyping platform. A heterozygote mapped to ``*`` names no alleles of its own."""

    profile_id: str
    base: str
    homozygous: dict[str, str] = field(default_factory=dict)
    heterozygous: dict[str, str | tuple[str, str]] = field(default_factory=dict)
    missing: tuple[str, ...] = ()
    builtin: bool = False

    @property
    def label(self) -> str:
        return self.profile_id if self.builtin else f"custom:{self.profile_id}"

    def tokens(self) -> list[str]:
        return [t.strip().upper() for t in (*self.missing, *self.homozygous, *self.heterozygous)]


# The built-in vocabularies. A heterozygote names its two symbols.
PROFILES: dict[str, Profile] = {
    p.profile_id: p
    for p in (
        Profile("tassel", "nucleotide", missing=("X", "XX"), builtin=True),
        Profile("soybase-report", "nucleotide", heterozygous={"H": "*"}, missing=("U",), builtin=True),
        Profile("dart", "none", {"0": "0", "1": "1"}, {"2": ("0", "1")}, ("", "-", "NA"), True),
        Profile("axiom", "none", {"AA": "A", "BB": "B", "0": "A", "2": "B"}, {"AB": ("A", "B"), "BA": ("A", "B"), "1": ("A", "B")},
                ("", "NoCall", "OTV", "-1", "-2", "--", "NA"), True),
        Profile("kasp", "none", {"X:X": "X", "Y:Y": "Y"}, {"X:Y": ("X", "Y"), "Y:X": ("X", "Y")},
                ("", "?", "Uncallable", "Missing", "NTC", "Dupe", "Bad", "NA"), True),
    )
}


def profile(ref: str | Profile | dict | None) -> Profile | None:
    """A built-in id, a ready profile, a profile document, or nothing."""
    if ref is None or ref == "default":
        return None
    if isinstance(ref, Profile):
        return ref
    if isinstance(ref, dict):
        hets = {k: v if isinstance(v, str) else tuple(v) for k, v in (ref.get("heterozygous") or {}).items()}
        return Profile(ref["id"], ref["base"], dict(ref.get("homozygous") or {}), hets, tuple(ref.get("missing") or ()))
    if ref not in PROFILES:
        raise ValueError(f"unknown token profile {ref!r}; built-in profiles: {', '.join(PROFILES)}")
    return PROFILES[ref]


def _call(kind: str, s1: Column | None = None, s2: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), (null if s1 is None else s1).alias("s1"), (null if s2 is None else s2).alias("s2")
    )


def _sorted_pair(x: Column, y: Column) -> Column:
    return _call("call", F.least(x, y), F.greatest(x, y))


def token(cell: Column) -> Column:
    """The form of a cell every comparison uses. Normalise once, before the calls are read."""
    return F.upper(strip(cell))


def nucleotide_call(t: Column, hapmap: bool = False, vocabulary: Profile | None = None) -> Column:
    """STRUCT(kind, s1, s2) of a normalised token, with kind call / missing / het / bad; symbols sorted.

    The platform vocabulary is tried before the nucleotide grammar, and frequent forms before rare ones.
    """
    format_missing = list(NUCLEOTIDE_MISSING + (HAPMAP_EXTRA_MISSING if hapmap else ()))
    if vocabulary is None:
        out = F.when(t.isin(format_missing), _call("missing"))
    else:
        silent = [m.strip().upper() for m in vocabulary.missing]
        if vocabulary.base == "nucleotide":
            silent += format_missing
        out = F.when(t.isin(silent), _call("missing"))
        for name, symbol in vocabulary.homozygous.items():
            out = out.when(t == name.strip().upper(), _call("call", F.lit(symbol), F.lit(symbol)))
        for name, pair in vocabulary.heterozygous.items():
            meaning = _call("het") if pair == "*" else _call("call", F.lit(min(pair)), F.lit(max(pair)))
            out = out.when(t == name.strip().upper(), meaning)
        if vocabulary.base == "none":
            return out.otherwise(_call("bad"))
    out = out.when(t.isin("A", "C", "G", "T"), _call("call", t, t)).when(
        t.rlike(r"^[ACGT][/|]?[ACGT]$"), _sorted_pair(F.substring(t, 1, 1), F.substring(t, -1, 1))
    )
    for code, pair in AMBIGUITY.items():
        out = out.when(t == code, _call("call", F.lit(pair[0]), F.lit(pair[1])))
    return out.when(t.rlike(r"^[ACGTN.\-][/|]?[ACGTN.\-]$"), _call("missing")).otherwise(_call("bad"))


def coded_call(t: Column) -> Column:
    """A normalised A/B/H token with the two parental symbols A and B."""
    return (
        F.when(t.isin(list(CODED_MISSING)), _call("missing"))
        .when(t.isin("A", "B"), _call("call", t, t))
        .when(t == "H", _call("call", F.lit("A"), F.lit("B")))
        .otherwise(_call("bad"))
    )


def votes_for_coding(t: Column, claimed: list[str]) -> Column:
    """Whether a token takes part in coding detection: missing cells and vocabulary tokens do not."""
    return ~t.isin(list(NUCLEOTIDE_MISSING) + claimed)


def resolve_marker(calls: Column, seeds: Column) -> Column:
    """Replace every symbol-free heterozygote of a marker by its two alleles; not exactly two (or an indel) is bad."""
    seen = F.array_sort(F.array_distinct(F.concat(
        seeds,
        F.flatten(F.transform(F.filter(calls, lambda c: c["kind"] == "call"), lambda c: F.array(c["s1"], c["s2"]))),
    )))
    usable = (F.size(seen) == 2) & ~F.array_contains(seen, "-")
    pair = F.when(usable, _call("call", F.try_element_at(seen, F.lit(1)), F.try_element_at(seen, F.lit(2)))).otherwise(_call("bad"))
    return F.transform(calls, lambda c: F.when(c["kind"] == "het", pair).otherwise(c))


def marker_alleles(calls: Column) -> Column:
    used = F.filter(calls, lambda c: c["kind"] == "call")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(used, lambda c: F.array(c["s1"], c["s2"])))))


def encode(call: Column, alleles: Column) -> tuple[Column, Column]:
    def index(symbol: Column) -> Column:
        return F.when(call["kind"] == "call", (F.array_position(alleles, symbol) - 1).cast("int"))

    return index(call["s1"]), index(call["s2"])


def _allele_index(text: Column) -> Column:
    # a longer text without a leading zero is at least 1000, beyond every accepted index
    return (
        F.when(text.isin("", "."), F.lit(None).cast("int"))
        .when(F.length(text) > 3, F.lit(HIGHEST_ALLELE + 1))
        .otherwise(text.try_cast("int"))
    )


def genotype_sides(gt: Column) -> dict[str, Column]:
    """The two sides of one GT text, both empty where it isn't one. Behind the first stand a separator and the second."""
    first = F.regexp_extract(gt, GT, 1)
    return {"first": first, "second": F.when(first != "", F.substring(gt, F.length(first) + 2, F.length(gt))).otherwise(F.lit(""))}


def genotype_of(gt: Column, first: Column, second: Column, n_alleles: Column) -> Column:
    """STRUCT(a1, a2, problem) of one GT text and its sides. NULL is a missing side, a haploid call counts twice."""
    a1 = _allele_index(first)
    a2 = F.when(second == "", a1).otherwise(_allele_index(second))
    problem = (
        F.when((gt != "") & (first == ""), F.lit("invalid GT"))
        .when((a1 > HIGHEST_ALLELE) | (a2 > HIGHEST_ALLELE), F.lit("allele index above 127"))
        .when(F.greatest(a1, a2) >= n_alleles, F.lit("allele index beyond the record's alleles"))
    )
    return F.struct(a1.alias("a1"), a2.alias("a2"), problem.alias("problem"))


def genotype_field(gt: Column, n_alleles: Column) -> Column:
    """STRUCT(a1, a2, problem) of one GT text; for many cells, ``genotype_sides`` first and ``genotype_of`` from them."""
    return genotype_of(gt, *genotype_sides(gt).values(), n_alleles)


# KASP export vocabulary.
KASP_PAIR = r"^[ACGT][:\-.]?[ACGT]$"
KASP_MISSING = ("Uncallable", "Missing", "Bad", "Dupe", "NTC")


def kasp_call(cell: Column) -> Column:
    """STRUCT(call, reason): the nucleotide pair as read, or NULL and why."""
    text = strip(F.coalesce(cell, F.lit("")))
    t = F.upper(text)
    reason = F.when(text == "", "empty").when(text == "?", "?")
    for token in KASP_MISSING:
        reason = reason.when(t == token.upper(), token)
    reason = reason.when(~t.rlike(KASP_PAIR), "unrecognized")
    pair = F.when(reason.isNull(), F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)))
    return F.struct(pair.alias("call"), reason.alias("reason"))


def linked_parts(token: Column, phased: Column, unphased: Column) -> Column:
    """The sides of a call from a variant-set page, by the page's own separators."""
    text = strip(token)
    one = F.when(phased != "", F.replace(text, phased, F.lit("\u0001"))).otherwise(text)
    two = F.when(unphased != "", F.replace(one, unphased, F.lit("\u0001"))).otherwise(one)
    return F.split(two, "\u0001")


def linked_call(token: Column, phased: Column, unphased: Column, unknown: Column) -> Column:
    """``linked_call_of`` the parts of a call; for many cells, ``linked_parts`` first and ``linked_call_of`` from them."""
    return linked_call_of(token, linked_parts(token, phased, unphased), unknown)


def linked_call_of(token: Column, parts: Column, unknown: Column) -> Column:
    """STRUCT(a1, a2, problem) of a call from a variant-set page and its parts.

    One missing side makes the whole call missing; index 127 is already refused here.
    """
    text = strip(token)
    x, y = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.size(parts))
    silent = F.coalesce(text, F.lit("")).isin("") | (text == unknown)

    def good(p: Column) -> Column:
        return (p == unknown) | (p.rlike("^[0-9]+$") & (F.coalesce(p.try_cast("int"), F.lit(HIGHEST_ALLELE)) < HIGHEST_ALLELE))

    bad = ~silent & ((F.size(parts) > 2) | ~good(x) | ~good(y))
    empty = silent | (x == unknown) | (y == unknown) | bad

    def side(p: Column) -> Column:
        return F.when(~empty, p.try_cast("int"))

    return F.struct(side(x).alias("a1"), side(y).alias("a2"), F.when(bad, F.lit("invalid GT")).alias("problem"))


def shared_alleles(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Size of the multiset intersection of two genotypes: 0, 1 or 2, and NULL unless both are called."""
    called = a1.isNotNull() & a2.isNotNull() & b1.isNotNull() & b2.isNotNull()
    same = ((a1 == b1) & (a2 == b2)) | ((a1 == b2) & (a2 == b1))
    some = (a1 == b1) | (a1 == b2) | (a2 == b1) | (a2 == b2)
    return F.when(called & same, 2).when(called & some, 1).when(called, 0)
