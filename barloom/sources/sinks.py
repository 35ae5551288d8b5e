"""Sinks: data sets as text, strategy descriptors, the trial store and the parity log reader."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, precision: int = 6) -> None:
    """CSV with ``time`` as yyyy.MM.dd HH:mm:ss and fixed decimals; null cells stay empty."""
    cells = [F.date_format(F.col("bar").cast("timestamp"), "yyyy.MM.dd HH:mm:ss").alias("time")]
    for f in df.schema.fields:
        if f.name == "bar":
            continue
        c = F.col(f.name)
        cells.append((F.when(c.isNotNull(), F.format_string(f"%.{precision}f", c)) if f.dataType.typeName() in ("double", "float") else c.cast("string")).alias(f.name))
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def descriptor(name: str, columns: list[str], params: dict) -> str:
    """JSON of a strategy: its (period, statistic, role) columns and a content id of 5 bytes."""
    parts = []
    for c in columns:
        period, stat, role, _ = c.split("_", 3)
        parts.append({"period": int(period), "statistic": stat, "role": role})
    body = {"name": name, "features": parts, "params": params}
    return json.dumps(body | {"id": hashlib.sha3_224(json.dumps(body, sort_keys=True).encode()).digest()[:5].hex()}, sort_keys=True)


def append_trial(spark: SparkSession, path: str, params: dict[str, str], metrics: dict[str, float]) -> None:
    """One row of the trial table."""
    row = spark.createDataFrame([(params, metrics)], "params map<string,string>, metrics map<string,double>")
    row.write.mode("append").parquet(path)


def read_parity_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, group_no, numbers): numbers of a UTF-16 terminal log, by time stamp and bracketed group, in line order; lines with fewer than 7 numbers go."""
    text = F.decode("content", "UTF-16")
    lines = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    ts = F.regexp_extract("line", r"(\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2})", 1)
    group = F.regexp_extract("line", r"\[\s*(\d+)\s*\]", 1)
    rest = F.regexp_replace(F.regexp_replace("line", r"\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}", " "), r"\[[^\]]*\]", " ")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    rows = lines.select("line_no", ts.alias("ts"), F.when(group != "", group).otherwise("0").cast("int").alias("group_no"), numbers.alias("numbers")).where("ts <> '' and size(numbers) >= 7")
    packed = rows.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("group_no", "line_no", "numbers"))).alias("x"))
    return packed.select("ts", F.size("x").alias("n_groups"), F.flatten(F.transform("x", lambda v: v.numbers)).alias("numbers"))
