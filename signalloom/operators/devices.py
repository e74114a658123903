"""The device table: default flags and selection. Names never decide what the default is; ids do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DeviceError


def with_default(devices: DataFrame, default_id: str | None) -> DataFrame:
    """is_default by id; a device without an id is never the default and gets an empty one."""
    return devices.withColumn("is_default", F.coalesce(F.col("id") == F.lit(default_id), F.lit(False))).withColumn("id", F.coalesce("id", F.lit("")))


def named(devices: DataFrame, query: str) -> DataFrame:
    """Devices whose name holds the query, whatever its case."""
    return devices.filter(F.contains(F.lower("name"), F.lit(query.lower())))


def select_device(devices: DataFrame, name: str | None = None, index: int | None = None, id: str | None = None):  # noqa: A002
    """The one row that fits a name part, an index or an exact id; without any, the default."""
    if name is not None:
        found = named(devices, name)
    elif index is not None:
        found = devices.filter(F.col("index") == index)
    elif id is not None:
        found = devices.filter((F.col("id") == id) & (F.col("id") != ""))
    else:
        found = devices.filter("is_default")
    rows = found.orderBy("index").take(2)
    if not rows:
        raise DeviceError("no device fits")
    if len(rows) > 1 and name is not None:
        raise DeviceError(f"several devices fit {name!r}: {', '.join(r['name'] for r in rows)}, ...; name one more exactly or by index")
    return rows[0]
