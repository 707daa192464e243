"""Configuration and schema records.

A record is a frozen dataclass whose fields carry their own check in their
metadata (``checked``). ``Record`` runs the checks and the record's ``RULES``
(conditions over several fields), and turns any record into plain JSON values and
back: tuples become lists, records become objects, unknown keys are ignored.
"""

from __future__ import annotations

import json
import typing
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, ClassVar

# The option literals that a configuration may hold.
NUMERIC_IMPUTE = ("median", "mean", "most_frequent", "constant_zero", "drop_rows")
CATEGORICAL_IMPUTE = ("most_frequent", "constant_missing")
NUMERIC_SCALE = ("standard", "minmax", "robust", "none")
OUTLIER = ("none", "iqr_clip", "winsorize")
CATEGORICAL_ENCODING = ("onehot", "ordinal", "frequency")
IMBALANCE = ("none", "class_weight", "smote")
DATETIME_PARTS = ("year", "month", "day", "weekday", "hour", "is_weekend")
TASK_TYPES = ("classification", "regression")
MISSING_TOKEN = "__MISSING__"

Check = tuple[Callable[[Any], bool], str]


def one_of(allowed: tuple[str, ...]) -> Check:
    return (lambda v: v in allowed), f"one of {', '.join(allowed)}"


def some_of(allowed: tuple[str, ...]) -> Check:
    return (lambda v: set(v) <= set(allowed)), f"some of {', '.join(allowed)}"


def at_least(least: float) -> Check:
    return (lambda v: v >= least), f"{least} or more"


def between(low: float, high: float) -> Check:
    """Strictly between; ``high`` may be infinite."""
    return (lambda v: low < v < high), f"above {low} and below {high}"


NOT_EMPTY: Check = (bool, "not empty")


def checked(check: Check, **how: Any) -> Any:
    return field(metadata={"check": check}, **how)


def _plain(value: Any) -> Any:
    """JSON form of a field's value."""
    if isinstance(value, Record):
        return value.to_dict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, tuple) else value


def _typed(value: Any, kind: Any) -> Any:
    """A JSON value as the field's type asks for it."""
    of = typing.get_args(kind)
    if value is None:
        return None
    if typing.get_origin(kind) is tuple:
        return tuple(_typed(v, of[0]) for v in value)
    if typing.get_origin(kind) is dict:
        return {k: _typed(v, of[1]) for k, v in value.items()}
    if is_dataclass(kind):
        return kind.from_dict(value)
    for option in of:  # a union: the first member that is no None
        if option is not type(None):
            return _typed(value, option)
    return value


class Record:
    """Checks and JSON for frozen dataclasses."""

    RULES: ClassVar[tuple[tuple[Callable[[Any], bool], str], ...]] = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            check = f.metadata.get("check")
            if check and not check[0](getattr(self, f.name)):
                raise ValueError(f"{f.name} must be {check[1]}, not {getattr(self, f.name)!r}")
        for holds, says in self.RULES:
            if not holds(self):
                raise ValueError(says)

    def to_dict(self) -> dict[str, Any]:
        return {f.name: _plain(getattr(self, f.name)) for f in fields(self)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    @classmethod
    def from_dict(cls, values: dict[str, Any] | None) -> typing.Self:
        kinds = typing.get_type_hints(cls)
        return cls(**{f.name: _typed(values[f.name], kinds[f.name]) for f in fields(cls) if f.name in (values or {})})

    @classmethod
    def from_json(cls, text: str) -> typing.Self:
        return cls.from_dict(json.loads(text))


@dataclass(frozen=True)
class PreprocessingConfig(Record):
    numeric_impute: str = checked(one_of(NUMERIC_IMPUTE), default="median")
    numeric_scale: str = checked(one_of(NUMERIC_SCALE), default="standard")
    outlier: str = checked(one_of(OUTLIER), default="none")
    outlier_iqr_k: float = checked(between(0.0, float("inf")), default=1.5)
    winsorize_p: float = checked(between(0.0, 0.5), default=0.01)
    categorical_impute: str = checked(one_of(CATEGORICAL_IMPUTE), default="most_frequent")
    categorical_encoding: str = checked(one_of(CATEGORICAL_ENCODING), default="onehot")
    highcard_threshold: int = checked(at_least(2), default=50)
    highcard_auto_downgrade: bool = True
    datetime_decompose: bool = False
    datetime_parts: tuple[str, ...] = checked(some_of(DATETIME_PARTS), default=())
    bool_as_numeric: bool = True
    imbalance: str = checked(one_of(IMBALANCE), default="none")
    smote_k_neighbors: int = checked(at_least(1), default=5)

    RULES = ((lambda c: c.datetime_parts or not c.datetime_decompose, "datetime_decompose needs datetime_parts"),)


@dataclass(frozen=True)
class TrainingConfig(Record):
    task_type: str = checked(one_of(TASK_TYPES))
    target_column: str = checked(NOT_EMPTY)
    excluded_columns: tuple[str, ...] = ()
    test_size: float = checked(between(0.0, 1.0), default=0.2)
    metric_key: str = ""
    preprocessing: PreprocessingConfig | None = None
    algorithms: tuple[str, ...] | None = None
    key_column: str | None = None  # unique row key used for reproducible splitting

    RULES = (
        (lambda c: c.algorithms != (), "algorithms must name one at least"),
        (lambda c: len(set(c.algorithms or ())) == len(c.algorithms or ()), "algorithms must not repeat"),
        (
            lambda c: c.task_type == "classification" or not c.preprocessing or c.preprocessing.imbalance != "smote",
            "imbalance smote needs a classification task",
        ),
    )


@dataclass(frozen=True)
class DerivedFeature(Record):
    name: str
    source: str
    kind: str


@dataclass(frozen=True)
class FeatureSchema(Record):
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    datetime: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    derived: tuple[DerivedFeature, ...] = ()
    vocabulary: str = ""  # where a bundle keeps every category of every column

    @property
    def input_columns(self) -> tuple[str, ...]:
        """Raw columns a scoring input must provide, datetime and boolean ones included."""
        return self.numeric + self.categorical + self.datetime + self.boolean
