"""Rows of a Spark query against rows of DuckDB SQL on the same tables."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, name)
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(df, sql, con):
    """None, or what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = {d[0]: str(d[1]).lower() for d in found.description}
    alike = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "timestamp_ntz": "timestamp", "boolean": "boolean", "date": "date", "binary": "blob"}
    odd = {n: (t, duck_types[n]) for n, t in spark_types.items() if alike.get(t) != duck_types[n]}
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall())
    if a != b:
        only = [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]
        return f"{len(a)} and {len(b)} rows; {only}"
    return f"types {odd}" if odd else None
