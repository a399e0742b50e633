"""A first configuration for a source tree, inferred from its files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..operators.mining import candidate_modules
from ..sources.config import Config
from ..sources.files import present

NOISE = [f"{d}/**" for d in ("build", "coverage", "e2e", "example", "examples", "fixtures", "spike", "test", "tests", "tmp")]
TESTS = [f"**/*.{kind}.{end}" for kind in ("test", "spec") for end in ("ts", "tsx", "mts", "cts")] + ["**/__tests__/**"]


def normalised_directory(arg: str) -> str:
    out = arg.strip().removeprefix("./").rstrip("/")
    if out.startswith(("/", "../")) or "*" in out:
        raise ReportError(f"{arg!r} is not a directory of this project.", "Name one below the project root.")
    return out


def plan(files: DataFrame, directory: str = "src") -> dict:
    """Modules, noise and test patterns found in `files` (path); candidates are few (one a directory)."""
    below = files.where(F.col("path").startswith(directory + "/"))
    rows = candidate_modules(below, files.sparkSession.createDataFrame([(directory,)], "anchor string")).orderBy("directory").collect()
    found = {r.glob for r in present(files, NOISE + TESTS).collect()}
    return {
        "schemaVersion": 1,
        "modules": {r["name"]: {"glob": f"{r.directory}/*" if r.directory == directory else f"{r.directory}/**"} for r in rows},
        "exclude": [g for g in NOISE + TESTS if g in found],
    }


def suggestions(uncovered: DataFrame, anchors: DataFrame) -> DataFrame:
    """Modules that would cover files of no module: (directory, name, files)."""
    return candidate_modules(uncovered.select("path"), anchors)


def config_text(config: dict) -> str:
    return json.dumps(config, indent=2, ensure_ascii=False) + "\n"


def type_union(config: Config) -> str:
    """Names and tags as enumerations, for editors to complete."""
    names = " | ".join(json.dumps(m.name) for m in config.modules)
    tags = " | ".join(json.dumps(t) for t in sorted({t for c in config.classify for t in c.tags}))
    return f"Module = {names or 'never'}\nTag = {tags or 'never'}\n"
