"""Trained models as standalone SQL: an expression that needs neither this package nor its tables.

Parameters are written as literals, so an expression is as long as its model; models over
``MAX_LITERALS`` numbers are an error (use the tables). The expressions give what the
models give, digit by digit.
"""

from __future__ import annotations

from ranklore.functions.models import EXP_SQUARINGS, LOGISTIC_SLOPE
from ranklore.operators.learned import LearnedIndex
from ranklore.operators.vector_hash import VectorHash

MAX_LITERALS = 100_000


def _number(x: float) -> str:
    return f"{float(x)!r}D" if x == x and abs(x) != float("inf") else f"double('{x}')"


def _exp1(x: str) -> str:
    text = f"(1.0D + ({x}) / 64.0D)"
    for _ in range(EXP_SQUARINGS):
        text = f"pow({text}, 2)"
    return text


def _normal(p: list[str], x: str) -> str:
    z = f"(({x}) - {p[0]}) / {p[1]}"
    return f"CASE WHEN {p[1]} <= 0 THEN 0.0D ELSE 1.0D / (1.0D + {_exp1(f'-{LOGISTIC_SLOPE!r}D * ({z})')}) * {p[2]} END"


#: Kind to expression of its parameters' texts and the key's text.
_FORMS = {
    "linear": lambda p, x: f"{p[0]} + {p[1]} * {x}",
    "cubic": lambda p, x: f"(({p[0]} * {x} + {p[1]}) * {x} + {p[2]}) * {x} + {p[3]}",
    "loglinear": lambda p, x: _exp1(f"{p[0]} + {p[1]} * {x}"),
    "normal": _normal,
    "lognormal": lambda p, x: _normal(p, f"CASE WHEN {x} > 0 THEN greatest(ln({x}), 0.0D) ELSE 0.0D END"),
}
_FORMS |= {"robust_linear": _FORMS["linear"], "linear_spline": _FORMS["linear"]}


def _position(raw: str) -> str:
    return f"CAST(CASE WHEN isnan({raw}) THEN 0 ELSE floor(least(greatest({raw}, 0.0D), 9.0E18D)) END AS BIGINT)"


def index_sql(index: LearnedIndex, key: str) -> dict[str, str]:
    """``prediction``, ``position`` and ``error`` of a learned index as Spark SQL over the column ``key``."""
    if any(name not in _FORMS for name in index.spec):
        raise ValueError(f"only models of {sorted(_FORMS)} can be written as SQL, not {index.spec}")
    x, leaf, literals = f"CAST({key} AS DOUBLE)", "0", 0
    for depth, (name, layer) in enumerate(zip(index.spec, index.layers, strict=True)):
        rows = sorted(layer.select("leaf", "p").collect(), key=lambda r: r["leaf"])  # one row a model
        literals += sum(len(r["p"]) for r in rows)
        if literals > MAX_LITERALS:
            raise ValueError(f"the model has more than {MAX_LITERALS} parameters: use its tables")
        if len(rows) == 1:
            parameters = [_number(v) for v in rows[0]["p"]]
        else:
            columns = [f"array({', '.join(_number(r['p'][i]) for r in rows)})" for i in range(len(rows[0]["p"]))]
            parameters = [f"element_at({c}, CAST({leaf} AS INT) + 1)" for c in columns]
        raw = f"({_FORMS[name](parameters, x)})"
        if depth < len(index.spec) - 1:
            leaf = f"least({_position(raw)}, {index.widths[depth + 1] - 1})"
    errors = sorted(index.errors.select("leaf", "max_err").collect(), key=lambda r: r["leaf"])
    error = f"element_at(array({', '.join(str(r['max_err']) + 'L' for r in errors)}), CAST({leaf} AS INT) + 1)"
    return {"prediction": raw, "position": _position(raw), "error": error}


def centroid_sql(model: VectorHash, vector: str) -> str:
    """The nearest active centroid of an array column as Spark SQL; ties go to the lower number."""
    rows = [(int(i), model.centroids[i]) for i in model.active]
    if sum(len(c) for _, c in rows) > MAX_LITERALS:
        raise ValueError(f"the model has more than {MAX_LITERALS} parameters: use its tables")
    far = []
    for i, c in rows:
        own = f"array({', '.join(_number(v) for v in c)})"
        d = f"aggregate(zip_with({vector}, {own}, (a, b) -> (CAST(a AS DOUBLE) - b) * (CAST(a AS DOUBLE) - b)), 0.0D, (s, v) -> s + v)"
        far.append(f"named_struct('d', {d}, 'c', {i}L)")
    return f"array_min(array({', '.join(far)})).c"
