"""Small tables that a test makes itself, for a Spark query and its DuckDB SQL."""

import datetime

import duckdb

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event(event_id, hour, user_id, kind, value):
    return event_id, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour), user_id, kind, value, "{}"


def written(spark, folder, **tables):
    """``folder`` with each table, a pair of rows and schema, as a directory of Parquet files, and a DuckDB connection that sees them."""
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), db
