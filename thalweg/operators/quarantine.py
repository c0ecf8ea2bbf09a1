"""Rows that fail to parse: typed rows on one side, failures with their reason on the other.

Each line is cut into cells by built-in regular expressions, the cells are exploded into (row, column, value),
joined to a small rule table, and the first broken rule of a row becomes its reason. Clean rows are what an
anti-join with the failures leaves. Only failures are ever shuffled to find reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a doubled quote while a line is being cut; a noncharacter, so no valid text holds it.
_TWIN = "￿"
#: One field after its comma: quoted (twins, then an odd quote up to the next), empty-or-twins quoted, or plain.
_FIELD = rf"\G,({_TWIN}*+\"[^\"]*+\"|{_TWIN}++|[^\",{_TWIN}]*+)(?=,|\z)"
#: A decimal number with optional exponent and blanks around it.
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_BLANKS = r"^[\s ]*$"

#: ordinal of the cell, reason, kind of check, bounds. Ordinals -2 and -1 are the layout of the row itself.
OUTLET_RULES = [
    (-2, "quoting", "empty", None, None),
    (-1, "columns", "equals", 5.0, None),
    (0, "id", "text", None, None),
    (1, "lat", "number", -60.0, 85.0),
    (2, "lng", "number", -180.0, 180.0),
]
_RULE_SCHEMA = "col int, rule_no int, reason string, kind string, lo double, hi double"


def rule_table(spark: SparkSession, rules: list[tuple] = OUTLET_RULES) -> DataFrame:
    """The rules as rows, ranked in the order given (a handful: its size is that of the list)."""
    rows = [(col, i, reason, kind, lo, hi) for i, (col, reason, kind, lo, hi) in enumerate(rules)]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def _comma_led(line: Column) -> Column:
    return F.concat(F.lit(","), F.replace(F.replace(line, F.lit(_TWIN), F.lit("�")), F.lit('""'), F.lit(_TWIN)))


def _unquoted(cell: Column) -> Column:
    raw = F.replace(cell, F.lit(_TWIN), F.lit('""'))
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), inner).otherwise(raw)


def split_cells(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `_cells`, the array of fields of a comma-separated record, and `_rest`, what no field could take.

    `_rest` is empty exactly if all quoting is sound. A null line counts as an empty one: a single empty field.
    """
    led = _comma_led(F.coalesce(F.col(line), F.lit("")))
    cells = F.transform(F.regexp_extract_all(led, F.lit(_FIELD), F.lit(1)), _unquoted)
    return df.withColumns({"_cells": cells, "_rest": F.regexp_replace(led, _FIELD, "")})


def check_value(value: Column, kind: str, lo: float | None, hi: float | None) -> Column:
    """Whether a cell's text breaks a rule of one kind; never null for text that is there."""
    if kind == "empty":
        return value != ""
    if kind == "equals":
        return F.coalesce(value.try_cast("double") != lo, F.lit(True))
    if kind == "text":
        return value.rlike(_BLANKS)
    number = F.trim(value).try_cast("double")
    return ~(value.rlike(_NUMBER) & F.coalesce((number > lo) & (number < hi), F.lit(False)))


def _broken() -> Column:
    """The same with the rule in the columns kind, lo and hi."""
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    out = None
    for kind in ("empty", "equals", "text", "number"):
        broken = check_value(value, kind, lo, hi)
        out = F.when(F.col("kind") == kind, broken) if out is None else out.when(F.col("kind") == kind, broken)
    return out


def failures(df: DataFrame, rules: list[tuple] = OUTLET_RULES, line: str = "line", key: str = "line_no") -> DataFrame:
    """(key, line, reason): one row per failing (key, line), with the first rule it breaks.

    Lines repeated under the same key give one row; a null key or line is kept as such (a null line fails like an
    empty one); an empty table gives an empty result; other columns of df are ignored, whatever their names.
    """
    rows = split_cells(df.select(F.col(key).alias("_key"), F.col(line).alias("_line")), "_line")
    layout = F.array(
        F.struct(F.lit(-2).alias("col"), F.substring("_rest", 1, 1).alias("value")),
        F.struct(F.lit(-1).alias("col"), F.size("_cells").cast("string").alias("value")),
    )
    wanted = sorted({r[0] for r in rules if r[0] >= 0})
    cells = F.filter(
        F.transform(F.col("_cells"), lambda c, i: F.struct(i.alias("col"), c.alias("value"))),
        lambda s: s["col"].isin(wanted),
    )
    exploded = rows.select("_key", "_line", F.explode(F.concat(layout, cells)).alias("_c")).select("_key", "_line", "_c.*")
    broken = exploded.join(F.broadcast(rule_table(df.sparkSession, rules)), "col").where(_broken())
    first = broken.groupBy("_key", "_line").agg(F.min("rule_no").alias("rule_no"))
    names = F.array(*[F.lit(r[1]) for r in rules])
    return first.select(F.col("_key").alias(key), F.col("_line").alias(line), F.get(names, F.col("rule_no")).alias("reason"))


def clean_rows(df: DataFrame, failed: DataFrame, line: str = "line", key: str = "line_no") -> DataFrame:
    """Typed outlets of the lines that `failed` does not hold: key, id, lat, lng, name, area.

    An unreadable `area` and an empty `name` become null; repeated lines stay repeated.
    """
    bad = failed.select(F.col(key).alias("_bk"), F.col(line).alias("_bl"))
    base = df.select(F.col(key).alias("_key"), F.col(line).alias("_line"))
    good = base.join(bad, F.col("_key").eqNullSafe(F.col("_bk")) & F.col("_line").eqNullSafe(F.col("_bl")), "left_anti")
    cells = split_cells(good, "_line")
    number = lambda i: F.expr(f"try_cast(trim(_cells[{i}]) as double)")
    return cells.select(
        F.col("_key").alias(key),
        F.trim(F.col("_cells")[0]).alias("id"),
        number(1).alias("lat"),
        number(2).alias("lng"),
        F.nullif(F.trim(F.col("_cells")[3]), F.lit("")).alias("name"),
        number(4).alias("area"),
    )
