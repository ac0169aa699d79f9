"""Order-insensitive comparison of a frame with the result of SQL."""

from __future__ import annotations

import decimal
import math

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR", "double": "DOUBLE",
    "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    spark_types, duck_types = dict(df.dtypes), dict(zip(relation.columns, map(str, relation.types), strict=True))
    for c in columns:
        if spark_types[c] in TYPES:
            assert TYPES[spark_types[c]] == duck_types[c], c
    at = [relation.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert left == right
