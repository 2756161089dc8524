"""Sizes, dates, ids and rates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.columns import as_col

_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")
_SIZE_TEXT = r"\A\s*([+-]?[0-9]+)(GB|MB|KB|B)?\s*\z"


def size_label(size: Column | str) -> Column:
    """'n B' below 1024, else one decimal and a unit; 1048575 is '1024.0 KB'."""
    size = as_col(size)
    label = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(_UNITS, start=1):
        number = F.replace(F.format_number(size / F.lit(float(1024**power)), 1), F.lit(","), F.lit(""))
        text = F.concat(number, F.lit(" " + unit))
        if power < len(_UNITS):
            label = label.when(size < 1024 ** (power + 1), text)
        else:
            label = label.otherwise(text)
    return label


def parse_size(text: Column | str, default: int) -> Column:
    """Bytes of '64MB', '10kb' or '512'; anything else gives the default."""
    upper = F.upper(as_col(text))
    number = F.regexp_extract(upper, _SIZE_TEXT, 1).try_cast("bigint")
    unit = F.regexp_extract(upper, _SIZE_TEXT, 2)
    factor = (
        F.when(unit == "GB", F.lit(1024**3)).when(unit == "MB", F.lit(1024**2))
        .when(unit == "KB", F.lit(1024)).otherwise(F.lit(1))
    )
    return F.coalesce(F.try_multiply(number, factor.cast("bigint")), F.lit(default).cast("bigint"))


def date_bucket(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy/MM/dd")


def operation_id(kind: Column | str, ts: Column | str) -> Column:
    """Type and second; two operations of a type in one second get the same id."""
    return F.concat_ws("-", as_col(kind), F.date_format(as_col(ts), "yyyyMMdd-HHmmss"))


def percent(done: Column | str, total: Column | str) -> Column:
    """Share in percent; no total, no value. It can exceed 100."""
    done, total = as_col(done), as_col(total)
    return F.when(total > 0, done.cast("double") / total * 100)


def elapsed_micros(start: Column | str, end: Column | str) -> Column:
    return F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))


def title(text: Column | str) -> Column:
    return F.initcap(F.replace(as_col(text), F.lit("_"), F.lit(" ")))
