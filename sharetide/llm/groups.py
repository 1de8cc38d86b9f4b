"""Values of a group brought back to its rows, whatever the size of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 256


def with_group(rows: DataFrame, keys: list[str], salt: Column, salts: int = SALTS, **values: tuple) -> DataFrame:
    """``rows`` (a stored table, as it is read twice) with one more column for each of ``values``.

    A value is (partial aggregate, function that combines the partials).  Rows are dealt out by key and
    salt, a key is present just in the salts that its rows carry, so no task gets all rows of a large group, and a key
    that occurs once moves once.  Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "_salt").agg(*[p.alias(name) for name, (p, _) in values.items()])
    total = partial.groupBy(*keys).agg(*[combine(name).alias(name) for name, (_, combine) in values.items()])
    back = partial.select(*keys, "_salt").join(total, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
