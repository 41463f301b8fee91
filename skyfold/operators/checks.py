"""Checks of tables and settings before work begins, and the settings' document. A failed check is a ValueError that says what is missing."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH_COLUMNS = ["lat_error_deg", "lon_error_deg", "gcp_lat_deg", "gcp_lon_deg", "gcp_alt"]  # fixed values
POSE_NAMES = {"spacecraft_position": "riss_ctrs", "boresight": "bhat_hs", "transformation_matrix": "t_hs2ctrs"}  # fixed values


def need_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def need_rows(df: DataFrame, what: str) -> DataFrame:
    """df, unless it is empty; one row is looked for."""
    if not df.limit(1).count():
        raise ValueError(f"{what} is empty")
    return df


def check_telemetry(df: DataFrame) -> DataFrame:
    return need_rows(df, "telemetry")


def check_science(df: DataFrame, time: str) -> DataFrame:
    return need_rows(need_columns(df, [time], "science data"), "science data")


def check_matches(df: DataFrame) -> DataFrame:
    """An image match result: the five error columns and the measurement they belong to."""
    return need_columns(df, [*MATCH_COLUMNS, "measurement"], "a match result")


def variable_name(names: dict[str, str] | None, concept: str) -> str:
    """The column that stands for a concept."""
    if not names or concept not in names:
        raise ValueError(f"no column is named for {concept!r}")
    return names[concept]


def check_error_input(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """What error statistics need: a match result with the three pose columns, under their own names."""
    return need_columns(check_matches(df), [variable_name(names or POSE_NAMES, c) for c in POSE_NAMES], "error statistics' input")


def need_key(key: str | None, what: str = "the control point's file") -> str:
    if key is None or not key.strip():
        raise ValueError(f"{what} must be named")
    return key


def calibration_files(sight: str | None, spread: str | None) -> tuple[str, str] | None:
    """Both files or neither."""
    if (sight is None) != (spread is None):
        raise ValueError("lines of sight and point spreads come together")
    return None if sight is None else (sight, spread)


def need_match_inputs(calibration: tuple[str, str] | None, own_function: bool) -> None:
    if calibration is None and not own_function:
        raise ValueError("matching needs lines of sight and point spreads, or a function of its own")


def scalar_nominal(value) -> float:
    """A parameter's nominal value; a list of one counts, other things are a TypeError."""
    if isinstance(value, (list, tuple)) and len(value) == 1:
        value = value[0]
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"a number is needed, not {value!r}")
    return float(value)


def check_regrid(size, resolution, bounds) -> None:
    """A grid's size and resolution exclude each other; bounds rise in both axes."""
    if size is not None and resolution is not None:
        raise ValueError("either a size or a resolution")
    if bounds is not None and not (bounds[0] < bounds[1] and bounds[2] < bounds[3]):
        raise ValueError("bounds are min_lon < max_lon, min_lat < max_lat")


def result_name(path: str) -> str:
    """Column name of a parameter's file: its stem without a version, in lower case, other characters as one underscore."""
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"_v\d+$", "", stem, flags=re.IGNORECASE).lower()).strip("_")


_UNITS = {"constant": "arcsec", "offset_kernel": "arcsec", "offset_time": "ms"}


def result_attributes(path: str, kind: str, units: str | None = None, long_name: str | None = None) -> dict[str, str]:
    """Attributes of a parameter's result column; units follow from its kind where none are given."""
    name = result_name(path)
    return {"name": f"param_{name}", "units": units or _UNITS.get(kind, "1"), "long_name": long_name or name.replace("_", " ")}


# --- the settings' document ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Setup:
    time_field: str = "corrected_timestamp"
    threshold_m: float = 250.0
    percent: float = 39.0
    minimum_correlation: float | None = None
    names: dict = field(default_factory=lambda: dict(POSE_NAMES))

    def __post_init__(self):
        if self.threshold_m <= 0 or not 0 <= self.percent <= 100:
            raise ValueError("a positive threshold and a percentage are needed")
        if self.minimum_correlation is not None and not -1 <= self.minimum_correlation <= 1:
            raise ValueError("a correlation lies in [-1, 1]")


@dataclass(frozen=True)
class SweepPlan:
    strategy: str = "random"
    iterations: int = 1
    seed: int | None = None
    parameters: tuple = ()

    def __post_init__(self):
        if self.strategy not in ("random", "grid", "single_offset"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.iterations < 1:
            raise ValueError("one iteration at least")


@dataclass(frozen=True)
class Output:
    path: str | None = None
    threshold_m: float | None = None

    def pinned(self, setup: Setup) -> Output:
        """With the requirement's threshold, whatever the document says."""
        return Output(self.path, setup.threshold_m)


def _section(kind, doc: dict, name: str):
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(doc) - known)
    if unknown:
        raise ValueError(f"section {name!r} knows no {unknown}")
    return kind(**{k: tuple(v) if k == "parameters" else v for k, v in doc.items()})


def load_settings(path_or_text: str) -> tuple[Setup, SweepPlan, Output]:
    """The three sections of a JSON document (setup, sweep, output); absent ones have their defaults, the output's threshold is the setup's."""
    doc = json.loads(path_or_text) if path_or_text.lstrip().startswith("{") else json.load(open(path_or_text, encoding="utf-8"))
    unknown = sorted(set(doc) - {"setup", "sweep", "output"})
    if unknown:
        raise ValueError(f"unknown sections {unknown}")
    setup = _section(Setup, doc.get("setup", {}), "setup")
    return setup, _section(SweepPlan, doc.get("sweep", {}), "sweep"), _section(Output, doc.get("output", {}), "output").pinned(setup)


def load_section(path_or_text: str, name: str):
    """One section alone."""
    return dict(zip(("setup", "sweep", "output"), load_settings(path_or_text), strict=True))[name]


def source_keys(matches: DataFrame) -> DataFrame:
    """Every measurement with the keys of where it came from: the first of the known attributes (a map column `attrs`), else result_N and gcp_N by table_index."""
    first = lambda names, other: F.coalesce(*[F.when(F.try_element_at("attrs", F.lit(n)) != "", F.try_element_at("attrs", F.lit(n))) for n in names], F.concat(F.lit(other), F.col("table_index").cast("string")))
    return matches.select("table_index", "measurement", first(["sci_key", "science_key", "science_file"], "result_").alias("sci_key"), first(["gcp_pair_id", "gcp_file", "gcp_key", "gcp_pair_index"], "gcp_").alias("gcp_key"))
