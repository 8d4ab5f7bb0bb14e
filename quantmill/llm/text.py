"""Column expressions for text that several operators share.  A null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words in the white-space definition of a word.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates words in the alphanumeric definition (ASCII letters and digits, and all that is not ASCII).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  ``lower`` does the same to ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separator: str = SPACE) -> Column:
    return F.array_remove(F.split(text, separator), "")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that working columns beside it cannot clash with the caller's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(names: list[str]) -> list[Column]:
    """The caller's columns of these names."""
    return [F.col(f"row.`{c}`").alias(c) for c in names]


def digest(text: Column) -> Column:
    """Stands for a text; never null, so that joins on it need no null check."""
    return F.md5(text)


def has_word(line: Column) -> Column:
    """Most lines show it by their first character; ``btrim`` looks at all of them."""
    return F.when(F.ascii(F.ltrim(line)) > 32, True).otherwise(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column that a lambda function refers to may be put back into it as an expression when a filter is pushed down,
    and would then be computed for every element.  A value bound this way cannot be.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
