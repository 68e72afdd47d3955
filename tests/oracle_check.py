"""Compare a Spark result with the oracle's, value by value."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Oracle types are compared with these Spark types.
_SAME = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "BOOLEAN": "boolean",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is None, str(v)) for v in row])


def differences(frame, connection, sql: str) -> list[str]:
    """Empty if names, types and all values are equal, whatever the order of rows."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: _SAME.get(str(d[1]), str(d[1])) for d in result.description}
    wanted = _sorted_rows(names, result.fetchall())
    found_types = {f.name: f.dataType.simpleString() for f in frame.schema}
    if found_types != types:
        return [f"schema {sorted(found_types.items())} is not {sorted(types.items())}"]
    found = _sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
    if len(found) != len(wanted):
        return [f"{len(found)} rows, not {len(wanted)}"]
    return [f"{a} is not {b}" for a, b in zip(found, wanted) if a != b][:5]
