"""Saving and loading of indexes: tables as Parquet, trained models as text.

A model's state is its plain values, arrays and nested models, written as JSON (arrays
in base64). Reading makes objects of the kinds listed here and nothing else, so a file
can't run code.
"""

from __future__ import annotations

import base64
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Modules whose classes may stand in a state.
_HOMES = ("codecs", "transforms", "coarse", "indexes", "graphs")


def _kinds() -> dict[str, type]:
    found = {}
    for home in _HOMES:
        module = importlib.import_module(f"ranklore.operators.{home}")
        found |= {k: v for k, v in vars(module).items() if isinstance(v, type) and v.__module__ == module.__name__}
    return found


def to_state(value):
    """What JSON can hold of a value, an array, or an object of a listed kind."""
    if isinstance(value, np.ndarray):
        kept = np.ascontiguousarray(value)
        return {"array": kept.dtype.str, "shape": list(kept.shape), "data": base64.b64encode(kept.tobytes()).decode()}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [to_state(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    name = type(value).__name__
    if _kinds().get(name) is not type(value):
        raise TypeError(f"a {name} cannot be saved")
    return {"kind": name, "state": {k: to_state(v) for k, v in vars(value).items()}}


def from_state(state):
    if isinstance(state, list):
        return [from_state(v) for v in state]
    if not isinstance(state, dict):
        return state
    if "array" in state:
        return np.frombuffer(base64.b64decode(state["data"]), np.dtype(state["array"])).reshape(state["shape"]).copy()
    kind = _kinds().get(state["kind"])
    if kind is None:
        raise ValueError(f"unknown kind {state['kind']!r}")
    made = kind.__new__(kind)
    vars(made).update({k: from_state(v) for k, v in state["state"].items()})
    return made


def save_index(index, path: str, spark: SparkSession) -> None:
    """Write an index below ``path`` (an error if there is something already): its tables, the
    indexes it is made of, and the rest as one line of JSON."""
    plain, tables, parts = {}, [], {}
    for name, value in vars(index).items():
        if isinstance(value, DataFrame):
            value.write.partitionBy(*index.partitions).parquet(f"{path}/{name}")
            tables.append([name, value.schema.json()])
        elif hasattr(value, "search"):
            save_index(value, f"{path}/{name}", spark)
            parts[name] = None
        elif isinstance(value, list) and value and all(hasattr(v, "search") for v in value):
            for i, one in enumerate(value):
                save_index(one, f"{path}/{name}-{i}", spark)
            parts[name] = len(value)
        else:
            plain[name] = to_state(value)
    line = json.dumps({"kind": type(index).__name__, "plain": plain, "tables": tables, "parts": parts})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/model")


def load_index(path: str, spark: SparkSession):
    """The index that ``save_index`` wrote to ``path``."""
    from pyspark.sql.types import StructType

    told = json.loads(spark.read.text(f"{path}/model").first()[0])
    kind = _kinds().get(told["kind"])
    if kind is None:
        raise ValueError(f"unknown kind {told['kind']!r}")
    made = kind.__new__(kind)
    values = {k: from_state(v) for k, v in told["plain"].items()}
    for name, schema in told["tables"]:
        values[name] = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{name}")
    for name, count in told["parts"].items():
        if count is None:
            values[name] = load_index(f"{path}/{name}", spark)
        else:
            values[name] = [load_index(f"{path}/{name}-{i}", spark) for i in range(count)]
    vars(made).update(values)
    return made
