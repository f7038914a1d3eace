"""A chain of analyses that keeps its inputs, results and a log of what was done."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.names import RESERVED
from cellweave.operators import mutual_information as mi
from cellweave.operators import patterns
from cellweave.operators.census import census_coordinates
from cellweave.operators.image import census_image
from cellweave.sources.bundle import load_result, save_result
from cellweave.sources.tables import load_coordinate_table


@dataclass
class State:
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    results: dict[str, Any] = field(default_factory=dict)
    log: list[dict[str, Any]] = field(default_factory=list)

    def record(self, operation: str, **details: Any) -> None:
        self.log.append({"operation": operation, "at": datetime.now(UTC), **details})


class Pipeline:
    """Load, census, measure, learn, map; each step returns its result and the loaders return the pipeline."""

    def __init__(self, spark: SparkSession, progress: Callable[[str, float], None] | None = None):
        self.spark, self.state, self.progress = spark, State(), progress

    def _done(self, operation: str, **details: Any) -> None:
        self.state.record(operation, **details)
        if self.progress:
            self.progress(operation, 1.0)

    def load_table(self, table: DataFrame | str, name: str = "table") -> Pipeline:
        self.state.inputs[name] = load_coordinate_table(self.spark, table) if isinstance(table, str) else table
        self._done("load_table", name=name)
        return self

    def load_image(self, voxels: DataFrame, name: str = "image") -> Pipeline:
        """Voxel rows; several images of one specimen are united."""
        held = self.state.inputs.get(name)
        self.state.inputs[name] = voxels if held is None else held.unionByName(voxels)
        self._done("load_image", name=name)
        return self

    def set_parameters(self, **parameters: Any) -> Pipeline:
        self.state.parameters.update(parameters)
        self._done("set_parameters", names=sorted(parameters))
        return self

    def census(self, source: str | None = None, **options: Any) -> DataFrame:
        """The census of an image if there is one, else of a table."""
        options = {k: v for k, v in self.state.parameters.items() if k in ("radii", "sample_size", "links", "variables", "random_state")} | options
        name = source or ("image" if "image" in self.state.inputs else "table")
        if name not in self.state.inputs:
            raise ValueError("load a table or an image first")
        data = self.state.inputs[name]
        if "image" in data.columns:
            options.pop("variables", None)
            wide, rows = census_image(data, **options)
            self.state.results["patches"] = rows
        else:
            options.pop("links", None)
            wide = census_coordinates(data, **options).drop("nbhd")
        self.state.results["census"] = wide
        self._done("census", source=name)
        return wide

    def _census(self) -> DataFrame:
        if "census" not in self.state.results:
            raise ValueError("take a census first")
        return self.state.results["census"]

    def measure_cis_mi(self, depth: int, **options: Any) -> DataFrame:
        out = self.state.results["cis_mi"] = mi.measure_cis_mi(self._census(), depth, **({"allow_permutation": True} | options))
        self._done("measure_cis_mi", depth=depth)
        return out

    def measure_trans_mi(self, censuses: Sequence[DataFrame], groups: dict[str, Sequence[str]], depth: int, **options: Any) -> DataFrame:
        out = self.state.results["trans_mi"] = mi.measure_trans_mi(censuses, groups, depth, **options)
        self._done("measure_trans_mi", depth=depth)
        return out

    def learn_patterns(self, ensemble: Sequence[str], radius: float, **options: Any) -> DataFrame:
        table, som = patterns.learn_pattern(self._census(), ensemble, radius, **options)
        self.state.results["pattern"], self.state.results["map_weights"] = table, som.weights
        self._done("learn_patterns", ensemble=list(ensemble), radius=radius)
        return table

    def map_patterns(self, bounds: Sequence[Sequence[float]], radius: float, semi_axes: Sequence[float], palette: Sequence[str], **options: Any) -> tuple[DataFrame, list[str]]:
        """Works on a reloaded result as well: the pattern is a table."""
        if "pattern" not in self.state.results:
            raise ValueError("learn a pattern first")
        voxels = self.state.inputs["image"].where(F.col("image").startswith("O"))
        out = patterns.map_pattern(self.state.results["pattern"], bounds, voxels, self._census(), radius, semi_axes, palette, **options)
        self.state.results["pattern_map"] = out[0]
        self._done("map_patterns", radius=radius)
        return out

    def get_results(self, name: str | None = None) -> Any:
        if name is None:
            return dict(self.state.results)
        if name not in self.state.results:
            raise KeyError(name)
        return self.state.results[name]

    @property
    def variables(self) -> list[str]:
        return [c for c in self._census().columns if c not in RESERVED]

    def save(self, destination: str) -> None:
        save_result({"parameters": self.state.parameters, "results": self.state.results, "log": self.state.log}, destination)

    def load(self, source: str) -> Pipeline:
        found = load_result(self.spark, source)
        self.state.parameters, self.state.results, self.state.log = found["parameters"], found["results"], found["log"]
        return self
