"""A model as a folder: its tables as Parquet, its settings as JSON. Nothing is pickled."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """Each table under its name; the settings, which name the tables, are written last and make the folder a model."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"format": FORMAT, "tables": sorted(tables), "settings": settings}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/settings").collect()))
    if meta["format"] != FORMAT:
        raise ValueError(f"unknown format {meta['format']}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta["settings"]


def model_card(name: str, settings: dict, info: list[dict]) -> str:
    """A description of a model in Markdown."""
    lines = [f"# {name}", "", f"{len(info)} topics.", "", "| Topic | Documents | Words |", "| --- | --- | --- |"]
    lines += [f"| {r['topic']} | {r['count']} | {', '.join(r['words'] or [])} |" for r in info]
    return "\n".join([*lines, "", "## Settings", "", *(f"* {k}: {v}" for k, v in sorted(settings.items())), ""])
