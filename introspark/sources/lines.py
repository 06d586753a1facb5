"""Text input as a table of lines: (file, ord, value), with ``ord`` increasing within a file.

Every reader is two steps: ``read_lines`` and a pure transformation of its result, so the same code
parses files, tables of lines, and test fixtures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.text import cells, chomp, is_blank, only_of, sniff_delimiter, strip
from introspark.operators.common import land


class SourceError(ValueError):
    """The first broken line of an input."""


def read_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Lines of text files (plain or gzip). A gzip file is one split: land large ones as Parquet first.

    Row ids grow within a partition and the splits of a file are laid out in offset order, so ``ord`` follows the file.
    With ``parts`` the folder ``path``, as Spark writes one, is one file: its numbered parts follow each other.
    """
    rows = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    if not parts:
        return rows.select("file", "ord", "value")
    number = F.regexp_extract("file", r"/part-([0-9]+)[^/]*$", 1).cast("bigint")
    return rows.select(F.lit(path).alias("file"), (number * (1 << 47) + F.col("ord")).alias("ord"), "value")


def content(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, without their carriage return."""
    return lines.filter(~is_blank(F.col("value"))).withColumn("value", chomp(F.col("value")))


def encoding_audit(lines: DataFrame) -> DataFrame:
    """Lines that are not valid UTF-8, per file: how many, and the first."""
    return lines.filter(~F.is_valid_utf8("value")).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("ord").alias("first_ord")
    )


#: Facts of files are broadcast up to this size (of their JSON text), measured before.
PER_FILE_BYTES = 4 << 20
#: Beyond it, a file of more lines than this is spread over so many parts.
FILE_LINES = 1 << 20
FILE_SALTS = 32


def by_file(rows: DataFrame, facts: DataFrame, most_bytes: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame, DataFrame, str], DataFrame]]:
    """(rows, parts, beside): ``beside(rows, parts(facts), how)`` gives rows the columns of ``facts``, a written table of at most
    one row per file.

    Further facts of the same files may follow, over rows that keep a column ``_salt`` where there is one: the rows stay where
    they are, and a plan that meets the same rows twice deals them once. ``parts`` repeats facts for each part of their file.

    The facts are sent to every executor if they measure at most ``most_bytes`` (``PER_FILE_BYTES`` by default). Beyond that
    there are many files, and rows meet the facts by file and a salt. A file may hold most of the rows, so the lines of files
    are counted, the large ones (few by their number of lines) are spread over salts, and only their facts are repeated.
    """
    measured = facts.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    if measured <= (PER_FILE_BYTES if most_bytes is None else most_bytes):
        return rows, lambda facts: facts, lambda rows, facts, how: rows.join(F.broadcast(facts), "file", how)
    large = [r["file"] for r in rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FILE_LINES).select("file").collect()]
    salts = F.when(F.col("file").isin(large) if large else F.lit(False), F.lit(FILE_SALTS)).otherwise(F.lit(1))

    def parts(facts: DataFrame) -> DataFrame:
        return facts.drop("_salt").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def beside(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
        return rows.join(facts.hint("merge"), ["file", "_salt"], how)

    return rows.withColumn("_salt", F.pmod(F.xxhash64("ord"), salts).cast("int")), parts, beside


def per_file(rows: DataFrame, facts: DataFrame, how: str = "left", most_bytes: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, a written table of at most one row per file."""
    rows, parts, beside = by_file(rows, facts, most_bytes)
    return beside(rows, parts(facts), how).drop("_salt")


def filled(text: DataFrame) -> DataFrame:
    return content(text).filter(~only_of(F.col("value"), ' \t,"'))


def headers(lines: DataFrame, looks_like_header: Column, delimiter: str | None = None) -> DataFrame:
    """(file, head_ord, delimiter, header): the header dictionary, written: the first line of each file that looks like one.

    Candidates are filtered by their text and aggregated where they are read: a few lines per file meet.
    """
    heads = filled(lines).filter(looks_like_header).groupBy("file").agg(F.min_by("value", "ord").alias("head"), F.min("ord").alias("head_ord"))
    d = sniff_delimiter(F.col("head")) if delimiter is None else F.lit(delimiter)
    return land(heads.select("file", "head_ord", d.alias("delimiter"), cells(F.col("head"), d).alias("header")), "headers")


def first_lines(lines: DataFrame) -> DataFrame:
    """The same dictionary for formats whose header is the first line, whatever it says; a blank one is no header."""
    first = lines.groupBy("file").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    first = filled(first).withColumnsRenamed({"value": "head", "ord": "head_ord"})
    d = sniff_delimiter(F.col("head"))
    return land(first.select("file", "head_ord", d.alias("delimiter"), cells(F.col("head"), d).alias("header")), "headers")


def headed(lines: DataFrame, heads: DataFrame | Column, delimiter: str | None = None) -> DataFrame:
    """(file, ord, value, head_ord, header, delimiter): content lines with the header of their file.

    ``heads`` is a header dictionary, or says which lines look like a header. ``head_ord`` is NULL in a file without a
    header, and rows that are blank in every cell are skipped.
    """
    if isinstance(heads, Column):
        heads = headers(lines, heads, delimiter)
    return per_file(filled(lines), heads)


def data_rows(headed_lines: DataFrame, *facts: str) -> DataFrame:
    """(file, ord, cells, header and further ``facts`` of the file): the rows after the header."""
    after = headed_lines.filter(F.col("ord") > F.col("head_ord"))
    return after.select("file", "ord", cells(F.col("value"), F.col("delimiter")).alias("cells"), "header", *facts)


def early_rows(headed_lines: DataFrame) -> DataFrame:
    """Violations: content before the header, or in a file without one."""
    early = F.col("head_ord").isNull() | (F.col("ord") < F.col("head_ord"))
    return headed_lines.filter(early).select(
        "file", "ord", F.lit("unexpected header").alias("kind"), F.substring("value", 1, 60).alias("detail")
    )


def named_rows(lines: DataFrame, columns: tuple[str, ...], delimiter: str | None = None, exact: bool = False) -> DataFrame:
    """(file, ord, one STRING column per name): cells by header name, trimmed.

    The header is the first line that holds the first name. Names compare case-insensitively, or as written with
    ``exact``. A name the header lacks, or a cell the row lacks, gives NULL.
    """
    first = columns[0]
    candidate = F.col("value").contains(first) if exact else F.lower("value").contains(first.lower())
    rows = data_rows(headed(lines, candidate, delimiter))
    names = F.transform("header", strip if exact else (lambda h: F.lower(strip(h))))
    picked = [
        strip(F.try_element_at("cells", F.nullif(F.array_position("_names", c.strip()).cast("int"), F.lit(0)))).alias(c.strip())
        for c in columns
    ]
    return rows.withColumn("_names", names).select("file", "ord", *picked)


def table_problems(lines: DataFrame, columns: tuple[str, ...], required: tuple[str, ...], delimiter: str | None = None) -> DataFrame:
    """Violations of a table read by ``named_rows``: rows before its header, files without one, required columns it lacks,
    and an input without any row."""
    found = headers(lines, F.lower("value").contains(columns[0].lower()), delimiter)
    rows = headed(lines, found)
    heads = found.select("file", F.col("head_ord").alias("ord"), F.transform("header", lambda h: F.lower(strip(h))).alias("names"))
    lacking = heads.select("file", "ord", F.explode(F.array_except(F.array(*[F.lit(c) for c in required]), "names")).alias("detail"))
    lacking = lacking.select("file", "ord", F.lit("missing column").alias("kind"), "detail")
    none = rows.agg(F.count_if(F.col("ord") > F.col("head_ord")).alias("n")).filter("n = 0").select(
        F.lit("").alias("file"), F.lit(0).cast("bigint").alias("ord"), F.lit("no rows").alias("kind"), F.lit("").alias("detail"))
    parts = [x.select("file", F.col("ord").cast("string").alias("ord"), "kind", "detail") for x in (early_rows(rows), lacking, none)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def repeated_columns(names: DataFrame) -> DataFrame:
    """Violations: sample columns that occur twice in a file, from its (file, names)."""
    twice = names.select("file", F.explode("names").alias("detail")).groupBy("file", "detail").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.select("file", F.lit(0).cast("bigint").alias("ord"), F.lit("sample column occurs twice").alias("kind"), "detail")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in input order, without ordering the whole key: a minimum over structs."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


@dataclass(frozen=True)
class Genotypes:
    """A parsed genotype source.

    markers: marker_id, chrom, pos_bp, cm, file_ord, alleles. calls: marker_id, sample_id, a1, a2.
    samples: the sample columns of the files. violations: file, ord, kind, detail.
    """

    markers: DataFrame
    calls: DataFrame
    samples: DataFrame
    violations: DataFrame
    coded: bool = False
    token_profile: str = "default"

    def require_clean(self) -> Genotypes:
        require_clean(self.violations)
        return self


def require_clean(violations: DataFrame) -> None:
    worst = violations.orderBy("file", "ord").select("file", "kind", "detail").first()
    if worst is not None:
        raise SourceError(f"{worst['file']}: {worst['kind']}: {worst['detail']}")


__all__ = [
    "Genotypes", "SourceError", "by_file", "content", "data_rows", "early_rows", "encoding_audit", "filled", "first_by", "first_lines", "headed", "headers",
    "named_rows", "per_file", "read_lines", "repeated_columns", "require_clean", "table_problems",
]
