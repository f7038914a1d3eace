"""Result bundles: a folder with manifest.json and one Parquet table for each DataFrame of a result."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import fields, is_dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA, VERSION = "cellweave.bundle", 1


class _Encoder:
    def __init__(self, tables: Path):
        self.tables, self.n = tables, 0

    def __call__(self, value: Any) -> Any:
        if value is None or isinstance(value, (bool, int, str)):
            return value
        if isinstance(value, float):
            return value if np.isfinite(value) else {"$float": repr(value)}
        if isinstance(value, np.generic):
            return self(value.item())
        if isinstance(value, datetime):
            return {"$time": value.isoformat()}
        if isinstance(value, DataFrame):
            self.n += 1
            value.write.parquet(str(self.tables / f"{self.n}.parquet"))
            return {"$table": f"tables/{self.n}.parquet"}
        if isinstance(value, np.ndarray):
            if value.dtype == object:
                raise TypeError("arrays of objects cannot be saved")
            return {"$array": value.tolist(), "dtype": str(value.dtype), "shape": list(value.shape)}
        if is_dataclass(value) and not isinstance(value, type):
            return {"$record": type(value).__name__, "fields": {f.name: self(getattr(value, f.name)) for f in fields(value)}}
        if isinstance(value, dict):
            if any(not isinstance(k, str) or k.startswith("$") for k in value):
                raise TypeError("mapping keys must be plain strings")
            return {k: self(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            out = [self(v) for v in value]
            return out if isinstance(value, list) else {"$tuple": out}
        raise TypeError(f"{type(value).__name__} cannot be saved")


def save_result(result: Any, destination: str) -> Path:
    """Write to a temporary folder beside the destination, then rename; an existing destination is never replaced."""
    target = Path(destination)
    if target.exists():
        raise FileExistsError(destination)
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=f".{target.name}.", dir=target.parent))
    try:
        (work / "tables").mkdir()
        content = _Encoder(work / "tables")(result)
        (work / "manifest.json").write_text(json.dumps({"schema": SCHEMA, "version": VERSION, "content": content}, allow_nan=False))
        os.replace(work, target)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return target


def load_result(spark: SparkSession, source: str) -> Any:
    """Read a bundle; records come back as dictionaries."""
    top = Path(source)
    if not (top / "manifest.json").is_file():
        raise FileNotFoundError(f"{source} is not a result bundle")
    manifest = json.loads((top / "manifest.json").read_text())
    if manifest.get("schema") != SCHEMA or manifest.get("version") != VERSION:
        raise ValueError("the bundle is of another kind or version")

    def back(value: Any) -> Any:
        if isinstance(value, list):
            return [back(v) for v in value]
        if not isinstance(value, dict):
            return value
        if "$table" in value:
            path = (top / value["$table"]).resolve()
            if not path.is_relative_to(top.resolve()):
                raise ValueError("bundle members must lie inside the bundle")
            return spark.read.parquet(str(path))
        if "$array" in value:
            return np.asarray(value["$array"], dtype=value["dtype"]).reshape(value["shape"])
        if "$float" in value:
            return float(value["$float"])
        if "$time" in value:
            return datetime.fromisoformat(value["$time"])
        if "$tuple" in value:
            return tuple(back(v) for v in value["$tuple"])
        if "$record" in value:
            return {"type": value["$record"], **{k: back(v) for k, v in value["fields"].items()}}
        return {k: back(v) for k, v in value.items()}

    return back(manifest["content"])


def load_data(spark: SparkSession, path: str) -> Any:
    """A bundle, a table, JSON or an npz archive by its path; pickles are refused."""
    p = Path(path)
    if p.suffix.lower() in (".pkl", ".pickle"):
        raise ValueError("pickle files are not read")
    if (p / "manifest.json").is_file():
        return load_result(spark, path)
    if p.suffix.lower() == ".json":
        return json.loads(p.read_text()) if p.is_file() else spark.read.json(path)
    if p.suffix.lower() == ".npz":
        with np.load(path, allow_pickle=False) as archive:
            return {k: archive[k] for k in archive.files}
    from cellweave.sources.tables import read_table

    return read_table(spark, path)


def save_data(data: Any, path: str, kind: str = "bundle") -> None:
    """bundle, csv, json, parquet or npz; an existing path is never replaced."""
    if Path(path).exists():
        raise FileExistsError(path)
    if kind == "bundle":
        save_result(data, path)
    elif kind == "npz":
        np.savez_compressed(path, **{k: np.asarray(v) for k, v in data.items()})
    elif kind == "json" and not isinstance(data, DataFrame):
        Path(path).write_text(json.dumps(data, allow_nan=False))
    elif kind in ("csv", "json", "parquet"):
        from cellweave.sources.tables import write_table

        write_table(data, path if path.endswith(f".{kind}") else f"{path}.{kind}")
    else:
        raise ValueError(f"no writer for {kind!r}")
