"""Arrow-batched wrappers of the kernels. Put them behind a filter: Spark evaluates a Python function for every row it gets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdelta.functions import kernels as K

#: Name in SQL to function.
SQL_NAMES = ("seq_ratio", "pair_amounts", "word_diff_html")

PAIRS = T.ArrayType(T.StructType([T.StructField("old", T.LongType()), T.StructField("new", T.LongType())]))


@F.pandas_udf(T.DoubleType())
def seq_ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([K.seq_ratio(a, b) for a, b in zip(old, new)], dtype=float)


def reaches(least: float):
    """Whether two texts have a ratio of ``least`` or more; NULL on either side counts as yes."""

    @F.pandas_udf(T.BooleanType())
    def near(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([a is None or b is None or K.reaches(a, b, least) for a, b in zip(old, new)], dtype=bool)

    return near


@F.pandas_udf(T.DoubleType())
def seq_ratio_move(old: pd.Series, new: pd.Series) -> pd.Series:
    """The ratio from the move threshold up, else 0."""
    return pd.Series([K.seq_ratio_from(a, b, K.MOVE_FROM) for a, b in zip(old, new)], dtype=float)


@F.pandas_udf(PAIRS)
def pair_amounts(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"old": a, "new": b} for a, b in K.pair_amounts(x, y)] for x, y in zip(old, new)], dtype=object)


@F.pandas_udf(T.StringType())
def word_diff_html(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([K.word_diff_html(a, b) for a, b in zip(old, new)], dtype=object)


def register(spark: SparkSession) -> None:
    """The kernels for SQL: ``seq_ratio``, ``pair_amounts``, ``word_diff_html``, and the table function ``parse_bill(path, content)``.

    ``select n.* from bills, lateral parse_bill(bills.path, bills.content) n`` gives the nodes of every document.
    """
    from lexdelta.sources.xml_bills import NODE_SCHEMA, node_rows

    for name in SQL_NAMES:
        spark.udf.register(name, globals()[name])

    class ParseBill:
        def eval(self, path: str, content: str):
            yield from node_rows(path, content)

    spark.udtf.register("parse_bill", F.udtf(ParseBill, returnType=NODE_SCHEMA))
