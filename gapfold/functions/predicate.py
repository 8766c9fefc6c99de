"""The filter mini-language: `name op number`, a list of them meaning AND."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"<": operator.lt, ">": operator.gt, "==": operator.eq, ">=": operator.ge, "<=": operator.le, "!=": operator.ne}
_TERM = re.compile(r"\s*\(?\s*([A-Za-z_][A-Za-z_0-9]*)\s*(<=|>=|==|!=|<|>)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*\)?\s*")


def parse(text: str) -> tuple[str, str, float]:
    """Raises ValueError for anything but one comparison."""
    m = _TERM.fullmatch(text)
    if not m:
        raise ValueError(f"not a comparison of a column with a number: {text!r}")
    return m[1], m[2], float(m[3])


def condition(query: str | list[str], columns: list[str]) -> Column:
    """The AND of the comparisons; NaN fails every one of them but `!=`."""
    terms = []
    for text in [query] if isinstance(query, str) else query:
        name, op, number = parse(text)
        if name not in columns:
            raise ValueError(f"no column {name!r}")
        terms.append(_OPS[op](F.col(name), F.lit(number)))
    return reduce(operator.and_, terms, F.lit(True))


def where(df: DataFrame, query: str | list[str] | None) -> DataFrame:
    """df filtered; plain comparisons, so Parquet scans push them down."""
    if not query:
        return df
    out = df.where(condition(query, df.columns))
    for text in [query] if isinstance(query, str) else query:
        name, op, _ = parse(text)
        if op in (">", ">=") and dict(df.dtypes)[name] in ("double", "float"):
            out = out.where(~F.isnan(name))  # NaN is above every number in Spark
    return out
