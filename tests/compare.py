"""Row comparison of a Spark result with DuckDB SQL over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType"):
        return None
    if hasattr(x, "tolist") and not hasattr(x, "item"):
        return str(x.tolist())
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted((tuple(norm(v) for v in r) for r in pdf[names].itertuples(index=False)), key=repr)
