"""Loading lines whose rows may fail to parse: good rows and failures with their reasons, in one pass.

Every column is first a nullable text; rules are Column expressions that give a reason or NULL; a row with an empty
reason array is loaded, any other is set apart with its reasons, in the order of the rules. What a rule looks at is
computed once a row (``once``); only lines with a double quote meet a regular expression for it. The checked rows are
written once, and both halves read that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vertexkey import once, plain, plain_code
from weftgraph.session import written

#: A field in quotes, and a field of either kind. Possessive, so that long fields need neither backtracking nor stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf'(?:{QUOTED}|[^"\t]*+)'


@dataclass(frozen=True)
class Split:
    good: DataFrame
    bad: DataFrame


def check_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with the column ``errors``: the names of all rules whose condition holds; a NULL condition doesn't hold."""
    found = F.array(*(F.when(broken, F.lit(name)) for name, broken in rules))
    return df.withColumn("errors", F.array_compact(found))


def split_rows(checked: DataFrame) -> Split:
    """Split a checked frame by empty error arrays; ``bad`` has the first reason as ``reason``."""
    return Split(checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0).withColumn("reason", F.col("errors")[0]))


def quoted_tsv(df: DataFrame, line: str = "line") -> DataFrame:
    """Add what the quoting rule gives: ``well_quoted``, ``n_fields`` and the text fields ``c0`` and ``c1``.

    Fields are separated by tabs; a field has no double quote or is wholly enclosed in them, inner ones doubled. Where
    quoting is broken ``n_fields``, ``c0`` and ``c1`` are NULL; c0 and c1 are also NULL unless there are two fields.
    Blank and NULL lines are removed: they are neither loaded nor failed.
    """
    text, tab = F.col(line), F.lit("\t")
    quotes = text.contains('"')
    tabs = lambda x: F.length(x) - F.length(F.replace(x, tab, F.lit("")))
    seen = once(df, {"__q": quotes, "well_quoted": F.when(quotes, text.rlike(rf"^{FIELD}(?:\t{FIELD})*+\z")).otherwise(True), "__blank": ~text.rlike(r"[^\s\p{IsWhite_Space}]")})
    seen = seen.filter("NOT __blank")  # also drops NULL lines
    bare = F.when(F.col("__q"), F.regexp_replace(text, QUOTED, "")).otherwise(text)
    # The first field of a line with quotes is matched; of any other it ends at the first tab.
    first = F.when(F.col("__q"), F.regexp_extract(text, f"^{FIELD}", 0)).otherwise(F.substring_index(text, "\t", 1))
    cut = once(seen, {"n_fields": F.when(F.col("well_quoted"), tabs(bare) + 1), "__f0": F.when(F.col("well_quoted"), first)})
    cut = once(cut, {"__f1": F.when(F.col("n_fields") == 2, F.substring(text, F.length("__f0") + 2, F.length(text)))})

    def content(f: Column) -> Column:
        inner = F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.col("n_fields") == 2, F.when(F.col("__q") & f.startswith('"'), inner).otherwise(f))

    return once(cut, {"c0": content(F.col("__f0")), "c1": content(F.col("__f1"))}).drop("__q", "__blank", "__f0", "__f1")


def load_match_lines(df: DataFrame) -> Split:
    """Load lines of two vertex keys. Reasons: ``quoting``, ``column_count``, ``bad_value``; repeated lines are all kept.

    ``good`` has line_id, c0 and c1 (text), v0 and v1 (key codes); ``bad`` has all columns of ``df``, ``errors`` and
    ``reason``. Very long lines are treated like any other; an empty table gives two empty ones.
    """
    parsed = quoted_tsv(df.drop("c0", "c1", "n_fields", "well_quoted", "errors", "reason"))
    parsed = once(parsed, {"__p0": plain(F.col("c0")), "__p1": plain(F.col("c1"))})
    parsed = once(parsed, {"v0": plain_code(F.col("__p0")), "v1": plain_code(F.col("__p1"))}).drop("__p0", "__p1")
    rules = [
        ("quoting", ~F.col("well_quoted")),
        ("column_count", F.col("n_fields") != 2),
        ("bad_value", (F.col("n_fields") == 2) & (F.col("v0").isNull() | F.col("v1").isNull())),
    ]
    halves = split_rows(written(check_rows(parsed, rules), "checked"))
    return Split(halves.good.drop("well_quoted", "n_fields"), halves.bad.drop("well_quoted", "n_fields", "c0", "c1", "v0", "v1"))
