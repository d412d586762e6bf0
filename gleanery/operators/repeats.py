"""Tables in which an id may come more than once but counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Repeated ids up to so many are sent to every task.
BROADCAST_IDS = 100_000


def settled(rows: DataFrame, key: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows in which every id counts once: ``settle`` gets those of repeated ids alone.

    Ids are counted without the texts beside them, so the texts of ids that come once, nearly all, are never shuffled.
    Where more than BROADCAST_IDS ids repeat, ``settle`` gets all rows.
    """
    again = [r[0] for r in rows.groupBy(key).count().filter("count > 1").select(key).limit(BROADCAST_IDS + 1).collect()]
    if not again:
        return rows
    if len(again) > BROADCAST_IDS:
        return settle(rows)
    ids = rows.sparkSession.createDataFrame([(i,) for i in again], StructType().add(key, rows.schema[key].dataType))
    same = rows[key].eqNullSafe(ids[key])  # a null id is an id like any other
    return rows.join(F.broadcast(ids), same, "left_anti").unionByName(settle(rows.join(F.broadcast(ids), same, "left_semi")))
