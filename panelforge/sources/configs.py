"""Configurations as JSON, and reports as fixed-width text."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame

from ..functions.kernels import Params


def read_config(text: str) -> Params:
    """A configuration from JSON; unknown keys and impossible values raise ValueError."""
    given = json.loads(text)
    known = {f.name for f in dataclasses.fields(Params)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown keys {unknown}")
    return Params(**given)


def identity(params: Params) -> str:
    """SHA-256 of a configuration in canonical form."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(params), sort_keys=True, allow_nan=False).encode()).hexdigest()


def text_report(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a small result as a table of fixed width."""
    found = [[("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(rows).collect()]
    lines = [df.columns, *found]
    wide = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(line, wide, strict=True)) for line in lines)
