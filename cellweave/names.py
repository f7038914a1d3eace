"""Column names of censuses: O<g>.<id>, S<g>.<c> and O<g>.<id>_S<g>.<c>."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Census columns that are never variables.
RESERVED = ("X", "Y", "Z", "Radius")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def natural_key(name: str) -> tuple:
    """Orders digit runs by value and the rest by lower case."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p)


def natural_sort(names: list[str]) -> list[str]:
    return sorted(names, key=natural_key)


def radius_key(radius: float) -> str:
    """A radius as a dictionary key: whole numbers without a fraction."""
    return str(int(radius)) if float(radius).is_integer() else str(float(radius))


def image_group(name: str) -> tuple[str, int]:
    """("O", 12) of "O12"."""
    if not (m := re.fullmatch(r"([OS])(\d+)", name)):
        raise ValueError(f"{name!r} is neither O<n> nor S<n>")
    return m[1], int(m[2])


def variables_of(columns: list[str]) -> list[str]:
    """The variables of a census: columns with an O or S in their name."""
    return [c for c in columns if c not in RESERVED and ("O" in c or "S" in c)]


def parse_variable(name: str) -> dict[str, int | None]:
    """object map, object id, scalar map and channel that a name speaks of."""
    o, s = re.search(r"O(\d+)\.(\d+)", name), re.search(r"S(\d+)\.(\d+)", name)
    return {"object_map": int(o[1]) if o else None, "object": int(o[2]) if o else None, "scalar_map": int(s[1]) if s else None, "channel": int(s[2]) if s else None}


def object_group(name: str) -> str | None:
    """The object map whose percentages a variable belongs to, for the composition rule."""
    return name.split(".")[0] if name.startswith("O") and "." in name else None
