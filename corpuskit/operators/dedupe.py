"""Distinct ids, keep-first de-duplication and the skip-existing anti join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def dedupe_first(df: DataFrame, key, order: Sequence[str] | str, order_is_unique: bool = False) -> DataFrame:
    """Keep the first row (smallest ``order``) of every ``key``.

    ``key`` is a column name, a list of names or a ``Column`` expression (e.g.
    ``sha1(text)``). One shuffle: ``min`` over a struct led by the order columns is
    combined map-side, so a key that holds a third of all rows is reduced to one row
    per map task before the exchange. Unlike ``dropDuplicates``, which row survives
    is defined.

    ``order_is_unique``: ``order`` is one column with a value of its own in every row (an id).
    Then only (key, order) is aggregated, by hash, and the rows of the winners are kept by a
    semi join, so wide columns are neither sorted nor shuffled for the aggregation.
    """
    order = _names(order)
    keys = _names(key)
    key_cols, key_names = [], []
    for i, k in enumerate(keys):
        if isinstance(k, Column):
            name = f"_key{i}"
            key_cols.append(k.alias(name))
            key_names.append(name)
        else:
            key_cols.append(F.col(k))
            key_names.append(k)
    if order_is_unique:
        (only,) = order
        winners = df.select(*key_cols, F.col(only)).groupBy(*key_names).agg(F.min(only).alias(only)).select(only)
        return df.join(winners, only, "left_semi").select(*df.columns)
    rest = [c for c in df.columns if c not in order and c not in key_names]
    first = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    out = df.groupBy(*key_cols).agg(first)
    return out.select(*[F.col(f"_first.{c}") if c not in key_names else F.col(c) for c in df.columns])


def distinct_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct non-null ids as strings (partial + final hash aggregate)."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias(id_col)).distinct()


def skip_existing(docs: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``existing``.

    A left-anti equi-join; the existing side is reduced to distinct keys first. No
    broadcast hint: Spark broadcasts it only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time), and uses a
    sort-merge anti join otherwise.
    """
    right = existing.select(F.col(key).cast(docs.schema[key].dataType).alias(key)) \
        .where(F.col(key).isNotNull()).distinct()
    return docs.join(right, on=key, how="left_anti")
