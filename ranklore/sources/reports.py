"""Reports of searches and benchmarks: flat metrics, CSV, Markdown and HTML. Driver-sized texts."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = "source string, metric string, value double, text string"


def flatten(value, name: str = "") -> Iterator[tuple[str, object]]:
    """(dotted name, leaf) of nested objects and lists; lists count from 0, empty ones leave nothing."""
    if isinstance(value, dict):
        for key in value:
            yield from flatten(value[key], f"{name}.{key}" if name else str(key))
    elif isinstance(value, (list, tuple)):
        for i, item in enumerate(value):
            yield from flatten(item, f"{name}.{i}" if name else str(i))
    else:
        yield name, value


def metrics_frame(spark: SparkSession, manifests: dict[str, dict]) -> DataFrame:
    """source, metric, value (numbers and truth values), text (anything else) of nested manifests."""
    rows = []
    for source, manifest in manifests.items():
        for name, leaf in flatten(manifest):
            number = float(leaf) if isinstance(leaf, (bool, int, float)) else None
            rows.append((source, name, number, None if number is not None or leaf is None else str(leaf)))
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def dominant_cost(costs: DataFrame, group: str, name: str, cost: str) -> DataFrame:
    """group, name, cost, share of the greatest cost of each group (of equal ones the first by name)."""
    greatest = costs.groupBy(group).agg(F.max(cost).alias("__top"), F.sum(cost).alias("__total"))
    held = costs.join(F.broadcast(greatest), group).filter(F.col(cost) == F.col("__top"))  # one row a group
    return held.groupBy(group).agg(F.min(name).alias(name), F.first("__top").alias(cost), F.first(F.col("__top") / F.col("__total")).alias("share"))


def attribution(costs: DataFrame, group: list[str], cost: str) -> DataFrame:
    """Rows, sum and share of the whole of a cost by group."""
    total = costs.agg(F.sum(cost).alias("__total"))
    return costs.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum(cost).alias(cost)).crossJoin(F.broadcast(total)).select(
        *group, "rows", cost, (F.col(cost) / F.col("__total")).alias("share")
    )


def _cell(value) -> str:
    return f"{value:.6g}" if isinstance(value, float) else "" if value is None else str(value)


def to_csv(header: list[str], rows: Iterable[Iterable]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows([[_cell(v) for v in row] for row in rows])
    return out.getvalue()


def to_markdown(header: list[str], rows: Iterable[Iterable]) -> str:
    lines = [header, ["-"] * len(header), *[[_cell(v).replace("|", "\\|") for v in row] for row in rows]]
    return "".join("| " + " | ".join(line) + " |\n" for line in lines)


def to_html(title: str, tables: dict[str, tuple[list[str], list]]) -> str:
    """A page without scripts: a heading and a table for each entry; all text is escaped."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, (header, rows) in tables.items():
        parts.append(f"<h2>{html.escape(name)}</h2><table border='1'>")
        parts.append("<tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in header) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in row) + "</tr>" for row in rows]
        parts.append("</table>")
    return "".join([*parts, "</body></html>"])


_FIGURES = ("quality", "recall", "auc", "rank_distance", "latency_ms", "size_bytes", "train_ms", "objective")


def selection_tables(told: dict) -> dict[str, tuple[list[str], list]]:
    """Roles, front and candidates of a search's result (``Outcome.as_dict``) as tables."""
    header = ["k", "knn", "spec", "branch", "two_opt", "graph_order", *_FIGURES]

    def row(m: dict) -> list:
        return [*[m["config"][c] for c in header[:6]], *[m[c] for c in _FIGURES]]

    tables = {"roles": (["role", *header], [[name, *row(m)] for name, m in told["roles"].items()]), "front": (header, [row(m) for m in told["front"]])}
    for name in ("calibrated", "candidates"):
        if name in told:
            tables[name] = (["skeleton", *header], [[m["skeleton"], *row(m)] for m in told[name]])
    return tables


def write_selection(spark: SparkSession, told: dict, folder: str) -> list[str]:
    """result.json, report.html and candidates.csv of a search below ``folder``, each a text folder."""
    tables = selection_tables(told)
    texts = {
        "result.json": json.dumps(told, sort_keys=True),
        "report.html": to_html("Configuration search", tables),
        "candidates.csv": to_csv(*tables["candidates" if "candidates" in tables else "calibrated"]),
    }
    for name, text in texts.items():
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return sorted(texts)
