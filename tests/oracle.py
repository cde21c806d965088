"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _cell(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def differences(con, df, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty if nothing does."""
    names = sorted(df.columns)
    shape = con.execute(f"DESCRIBE {sql}").fetchall()
    types = {r[0]: r[1] for r in shape}
    if sorted(types) != names:
        return [f"columns {names} vs {sorted(types)}"]
    found = [
        f"type of {n}: {t} vs {types[n]}"
        for n, t in df.dtypes
        if _KINDS.get(t, t) != types[n] and not t.startswith("array")
    ]
    quoted = ", ".join('"' + n + '"' for n in names)
    want = [tuple(map(_cell, r)) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()]
    got = [tuple(map(_cell, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    if len(want) != len(got):
        return [*found, f"{len(got)} rows vs {len(want)}"]
    want.sort(key=_key)
    got.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
        found.append(f"{len(bad)} of {len(want)} rows differ, e.g. {cells[:4]} in {g[:5]}")
    return found
