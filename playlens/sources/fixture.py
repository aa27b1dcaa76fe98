"""The raw gameplay table used by tests and benchmarks.

The reference ships no data, so the raw table is derived from the driver's
``events`` table by pure arithmetic (FIXTURES.md §3). The same expression
texts are rendered for Spark SQL and for DuckDB, so both engines build the
same rows; only two spellings differ (microseconds since the epoch and
integer division).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.model import RAW_COLUMNS

SPARK = {
    "US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "DIV": "(({a}) DIV {b})",
    "STR": "STRING",
}
DUCKDB = {
    "US": "epoch_us(ts)",
    "DIV": "(({a}) // {b})",
    "STR": "VARCHAR",
}

# The derivation of FIXTURES.md §3, helper values then columns.
# ``{DIV:a|b}`` and ``{US}`` / ``{STR}`` are the two dialect spellings.
HELPERS = [
    ("e", "event_id"),
    ("et", "event_type"),
    ("v", "value"),
    ("us", "{US}"),
    ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"),
    ("u", "CASE WHEN e % 997 = 1 THEN 100000 + e ELSE user_id END"),
    ("d", "CAST({DIV:us - 1704067200000000|86400000000} AS BIGINT)"),
    ("su", "CASE WHEN u % 10 = 9 THEN u - 1 ELSE u END"),
    ("tu", "CASE WHEN e % 23 = 2 OR (u % 37 = 5 AND d % 4 = 1) THEN NULL ELSE u END"),
]
COLUMNS = [
    ("user_id", "CASE WHEN tu IS NULL THEN NULL WHEN e % 7 = 1 THEN '2.45533E+16' ELSE CAST(tu AS {STR}) END"),
    ("user_id2", "CAST(tu AS {STR})"),
    ("event_timestamp", "CASE WHEN e % 7 = 3 THEN '1.70407E+15' ELSE CAST(us AS {STR}) END"),
    ("event_timestamp2", "CAST(us AS {STR})"),
    ("batch_event_index", "CASE WHEN e % 41 = 9 THEN NULL ELSE CAST(e % 5 AS INT) END"),
    ("event_name", "CASE WHEN et IN ('signup','view') THEN 'level_start' ELSE 'level_end' END"),
    ("app_version", "CASE WHEN e % 11 = 3 OR u % 29 = 7 THEN NULL WHEN (u + {DIV:d|15}) % 3 = 0 THEN '1.2.0' "
                    "WHEN k < 50 THEN '1.1.0' ELSE '1.0.9' END"),
    ("session_id", "su * 1000 + {DIV:d|2}"),
    ("time_played", "CASE WHEN et IN ('signup','view') OR e % 29 = 7 THEN NULL ELSE v END"),
    ("country", "CASE CAST(u % 12 AS INT) WHEN 0 THEN 'VN' WHEN 1 THEN 'US' WHEN 2 THEN 'BR' WHEN 3 THEN 'IN' "
                "WHEN 4 THEN 'ID' WHEN 5 THEN 'PH' WHEN 6 THEN 'TH' WHEN 7 THEN 'MX' WHEN 8 THEN 'DE' "
                "WHEN 9 THEN 'FR' WHEN 10 THEN 'JP' ELSE NULL END"),
    ("level", "CASE WHEN e % 19 = 6 OR e % 997 = 1 THEN NULL ELSE CAST(1 + {DIV:d|3} + u % 2 + "
              "CASE WHEN k % 10 = 0 THEN 3 WHEN k % 10 = 1 THEN 1 ELSE 0 END AS INT) END"),
    ("is_success", "CASE WHEN et IN ('signup','view') OR e % 31 = 8 THEN NULL WHEN et = 'purchase' THEN 'TRUE' "
                   "WHEN et = 'error' THEN 'FALSE' WHEN v < 40 THEN 'TRUE' ELSE 'FALSE' END"),
    ("game_mode", "CASE WHEN e % 13 = 4 THEN NULL WHEN k % 3 = 0 THEN 'hard' ELSE 'normal' END"),
    ("device_category", "CASE WHEN u % 5 = 0 THEN 'tablet' ELSE 'mobile' END"),
    ("mobile_brand_name", "CASE WHEN e % 17 = 5 OR u % 31 = 3 THEN NULL WHEN u % 4 = 0 THEN 'Apple' "
                          "WHEN u % 4 = 1 THEN 'Samsung' ELSE 'Xiaomi' END"),
    ("operating_system", "CASE WHEN u % 4 = 0 THEN 'iOS' ELSE 'Android' END"),
]
# Number of stored copies of each event: a second copy if e % 50 = 10,
# a third if e % 250 = 10.
COPIES = "1 + CASE WHEN e % 50 = 10 THEN 1 ELSE 0 END + CASE WHEN e % 250 = 10 THEN 1 ELSE 0 END"


def render(text: str, dialect: dict) -> str:
    out = text.replace("{US}", dialect["US"]).replace("{STR}", dialect["STR"])
    while "{DIV:" in out:
        start = out.index("{DIV:")
        end = out.index("}", start)
        a, b = out[start + 5:end].split("|")
        out = out[:start] + dialect["DIV"].format(a=a, b=b) + out[end + 1:]
    return out


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def game_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 16-column gameplay table, with its planted dirt and copies."""
    df = load_events(spark, sf_dir)
    helpers = df.select(*[F.expr(render(expr, SPARK)).alias(name) for name, expr in HELPERS[:4]],
                        "props", "user_id")
    helpers = helpers.withColumn("k", F.expr(render(HELPERS[4][1], SPARK)))
    for name, expr in HELPERS[5:]:
        helpers = helpers.withColumn(name, F.expr(render(expr, SPARK)))
    # Each event is emitted 1-3 times by a generator, not by a join.
    copies = helpers.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.expr(COPIES))))
    return copies.select(*[F.expr(render(expr, SPARK)).alias(name) for name, expr in COLUMNS])


def duckdb_raw_sql() -> str:
    """The same derivation as a DuckDB query over the ``events`` view."""
    h = ",\n".join(f"    {render(expr, DUCKDB)} AS {name}" for name, expr in HELPERS[:4])
    steps = [f"SELECT {h},\n    props, user_id\n  FROM events"]
    for name, expr in HELPERS[4:]:
        steps.append(f"SELECT *, {render(expr, DUCKDB)} AS {name} FROM __prev")
    sql = steps[0]
    for step in steps[1:]:
        sql = step.replace("__prev", f"(\n{sql}\n)")
    cols = ",\n".join(f"    {render(expr, DUCKDB)} AS {name}" for name, expr in COLUMNS)
    return (f"SELECT\n{cols}\nFROM ({sql}) h, "
            f"(VALUES (1), (2), (3)) c(copy)\nWHERE copy <= {COPIES}")


assert [n for n, _ in COLUMNS] == RAW_COLUMNS
