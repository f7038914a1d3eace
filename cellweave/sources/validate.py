"""Input reports: what a table, census or image holds and what is wrong with it."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.names import RESERVED

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def validate(data: Any, kind: str = "auto", *, raise_on_error: bool = False) -> dict:
    """type, valid, errors and shape of data; kind is auto, table, census or image."""
    if kind == "auto":
        kind = "image" if isinstance(data, np.ndarray) else "census" if isinstance(data, DataFrame) and "Radius" in data.columns else "table"
    if kind not in ("table", "census", "image"):
        raise ValueError("data_type must be auto, table, census or image")
    errors: list[str] = []
    report: dict[str, Any] = {"type": kind}
    if kind == "image":
        a = np.asarray(data)
        report["shape"] = list(a.shape)
        if a.ndim not in (2, 3, 4):
            errors.append("images must have two, three or four dimensions")
        if a.dtype.kind not in "uifb" or (a.dtype.kind == "f" and not np.isfinite(a).all()):
            errors.append("image values must be finite numbers")
    elif not isinstance(data, DataFrame):
        errors.append("a DataFrame is needed")
    else:
        kinds = dict(data.dtypes)
        report["columns"] = data.columns
        need = ["X", "Y", "Z", "Radius"] if kind == "census" else []
        axes = [c for c in data.columns if c.lower() in ("x", "y", "z")]
        errors += [f"missing column {c}" for c in need if c not in kinds]
        if kind == "table" and not {"x", "y"} <= {c.lower() for c in axes}:
            errors.append("coordinate columns x and y are missing")
        if kind == "census" and not [c for c in data.columns if c.startswith(("O", "S"))]:
            errors.append("a census needs variables O... or S...")
        errors += [f"{c} must be numeric" for c in (axes + (["Radius"] if "Radius" in kinds else [])) if kinds[c] not in NUMBERS]
        sound = [c for c in axes if kinds[c] in NUMBERS]
        missing = [F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(c) for c in sound]
        row = data.agg(F.count("*").alias("__n"), *missing).first()
        report["rows"] = row["__n"]
        if not row["__n"]:
            errors.append("there are no rows")
        errors += [f"{c} has missing values" for c in sound if row[c]]
        if kind == "census" and "Radius" in kinds:
            report["radii"] = {float(r["Radius"]): r["count"] for r in data.groupBy("Radius").count().collect() if r["Radius"] is not None}
            report["variables"] = [c for c in data.columns if c not in RESERVED]
    report |= {"valid": not errors, "errors": errors}
    if errors and raise_on_error:
        raise ValueError("; ".join(errors))
    return report
