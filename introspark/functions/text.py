"""Cell-level text helpers shared by every text source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from a cell.
_SPACES = (
    " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def _begins_in(line: Column, characters: str) -> Column:
    """Whether a line is empty or begins with one of the characters or an end of line: a cheap test before a pattern."""
    return F.substring(line, 1, 1).isin("", *characters, *"\n\r\u0085\u2028\u2029")


def only_of(line: Column, characters: str) -> Column:
    """Whether a line holds nothing but the characters."""
    return _begins_in(line, characters) & line.rlike(f"^[{characters}]*$")


def is_blank(line: Column) -> Column:
    """Only spaces and tabs make a line blank."""
    return _begins_in(line, " \t") & line.rlike(r"^[ \t]*\r?$")


def chomp(line: Column) -> Column:
    return F.when(line.contains("\r"), F.regexp_replace(line, r"\r+$", "")).otherwise(line)


def cells(line: Column, delimiter: Column) -> Column:
    """Cells of one line delimited by commas or tabs. Lines without a quote take the cheap path."""

    def unquote(x: Column) -> Column:
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.when(x.startswith('"'), inner).otherwise(x)

    def by(d: str) -> Column:
        # a quoted cell is matched together with its closing delimiter, hence the one appended here
        matched = F.regexp_extract_all(F.concat(line, F.lit(d)), F.lit(f'("(?:[^"]|"")*"|[^{d}]*){d}'), F.lit(1))
        return F.when(line.contains('"'), F.transform(matched, unquote)).otherwise(F.split(line, d, -1))

    return F.when(delimiter == "\t", by("\t")).otherwise(by(","))


def sniff_delimiter(header: Column) -> Column:
    return F.when(header.contains("\t"), F.lit("\t")).otherwise(F.lit(","))


# The number grammars of the file contract. A minus sign is tolerated before a zero.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
SIGNED_DIGITS = r"^[+-]?[0-9]+$"
DIGITS = r"^[0-9]+$"
_NOT_NEGATIVE = r"^(?:\+|-(?=[0.]*(?:[eE]|$)))?"
WHOLE_POSITION = _NOT_NEGATIVE + "[0-9]+$"
NUMBER_POSITION = _NOT_NEGATIVE + NUMBER.removeprefix("^[+-]?")


def position(cell: Column, digits_only: bool = False) -> Column:
    """A whole non-negative position, or NULL when the text is not one."""
    text = strip(cell)
    whole = F.when(text.rlike(DIGITS if digits_only else WHOLE_POSITION), text.try_cast("bigint"))
    if digits_only:
        return whole
    number = text.try_cast("double")
    return whole.when(text.rlike(NUMBER_POSITION), F.when(number == F.floor(number), number.try_cast("bigint")))


def decimal_number(cell: Column) -> Column:
    """A finite plainly written number, or NULL."""
    text = strip(cell)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def centimorgan(cell: Column) -> Column:
    """Map position; NULL for the four spellings of 'absent' and for text that is not a number."""
    text = strip(cell)
    return F.when(~F.coalesce(text, F.lit("")).isin("", "NA", "na", "."), text.try_cast("double"))


def after_last_dot(name: Column) -> Column:
    return F.substring_index(name, ".", -1)
