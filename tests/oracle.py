"""A Spark query and its DuckDB SQL, side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return db


def _text(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return "0" if abs(value) < 5e-7 else f"{value:.6g}"
    return str(value.tolist()) if hasattr(value, "tolist") else str(value)


def rows(frame):
    names = sorted(frame.columns)
    data = frame[names].astype(object)
    data = data.where(frame[names].notna(), None)
    return names, sorted("|".join(_text(int(v) if isinstance(v, float) and v == math.floor(v) and abs(v) < 1e15 else v) for v in r) for r in data.itertuples(index=False))


def same(query, sql, spark, sf_dir, db):
    got, wanted = rows(query(spark, sf_dir).toPandas()), rows(db.execute(sql).df())
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert [x for x in got[1] if x not in set(wanted[1])][:3] == []
    assert got[1] == wanted[1]
