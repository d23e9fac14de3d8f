"""Vertex keys: three Latin letters and nine decimal digits, written in many ways.

A key is carried as one long that sorts like the lower-case key text; text is made only for results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 1_000_000_000


def stripped(c: Column) -> Column:
    """The value without every character that is not a letter or digit."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


#: How most values are written; for these the key is cut out by position, which spares the general rule.
COMMON = r"^[A-Za-z]{3}-[0-9]{9}\z"
USABLE = r"^[A-Za-z]{3}[0-9]{9}$"


def plain(c: Column) -> Column:
    """The lower-case letters and digits of a value; NULL for NULL."""
    return F.lower(F.when(c.rlike(COMMON), F.concat(F.substring(c, 1, 3), F.substring(c, 5, 9))).otherwise(stripped(c)))


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with further columns that are computed once a row, whatever filters and projections follow.

    A generator stands between: the optimizer pushes nothing that uses the new columns below it, and doesn't copy their
    expressions into each place of use.
    """
    return df.select("*", F.inline(F.array(F.struct(*(x.alias(c) for c, x in columns.items())))))


def plain_key(p: Column) -> Column:
    """The key text of a value that ``plain`` was applied to; NULL if it is no usable key."""
    return F.when(p.rlike(USABLE), p)


def plain_code(p: Column) -> Column:
    """The key of a value that ``plain`` was applied to, as a long; NULL if it is no usable key."""
    place = [F.ascii(F.substring(p, i, 1)) - 97 for i in (1, 2, 3)]
    head = (place[0] * 676 + place[1] * 26 + place[2]).cast("long") * F.lit(DIGITS).cast("long")
    return F.when(p.rlike(USABLE), head + F.substring(p, 4, 9).cast("long"))


def vertex_key(c: Column) -> Column:
    """The lower-case key text of a formatted value; NULL where the value is NULL or holds no usable key."""
    return plain_key(plain(c))


def vertex_code(c: Column) -> Column:
    """The key of a formatted value as a long; NULL where the value is NULL or holds no usable key."""
    return plain_code(plain(c))


def coded(df: DataFrame, fields: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the key code of each field under its name, NULL where it is NULL or holds no usable key."""
    cleaned = once(df.select(*keep, *(x.alias(f"__{c}") for c, x in fields.items())), {f"__p_{c}": plain(F.col(f"__{c}")) for c in fields})
    return once(cleaned, {c: plain_code(F.col(f"__p_{c}")) for c in fields}).select(*keep, *fields)


def code_text(code: Column) -> Column:
    """The lower-case key text (12 characters) of a code."""
    number = F.pmod(code, F.lit(DIGITS).cast("long"))
    prefix = ((code - number) / F.lit(DIGITS)).cast("int")
    places = [(prefix / 676).cast("int"), (F.pmod(prefix, F.lit(676)) / 26).cast("int"), F.pmod(prefix, F.lit(26))]
    return F.concat(*(F.char((x + 97).cast("long")) for x in places), F.lpad(number.cast("string"), 9, "0"))


def sql_key(column: str) -> str:
    """DuckDB SQL for the key text of a column, NULL if unusable."""
    s = rf"regexp_replace({column}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
    return f"CASE WHEN regexp_full_match({s}, '[A-Za-z]{{3}}[0-9]{{9}}') THEN lower({s}) END"


def sql_code(column: str) -> str:
    """DuckDB SQL for the key of a column as a number, NULL if unusable."""
    k = sql_key(column)
    return f"list_transform([{k}], lambda k: ((ascii(k[1]) - 97) * 676 + (ascii(k[2]) - 97) * 26 + ascii(k[3]) - 97)::BIGINT * {DIGITS} + k[4:12]::BIGINT)[1]"
