"""The declarative task: what to predict, from which rows, how to split and how to ask."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.labels import LabelTransform
from kinfold.operators import splits
from kinfold.operators.graph import NODE
from kinfold.operators.inference import InferenceFilter
from kinfold.schema import LogicalType, Table

BINARY, REGRESSION, MULTICLASS = "binary_classification", "regression", "multiclass_classification"
# The names that fingerprints are made of.
_TASKS = {BINARY: "bin", REGRESSION: "reg", MULTICLASS: "cls"}
_SPLITS = {"temporal": "temp", "random": "rand"}


@dataclass(frozen=True)
class TaskSpec:
    target_table: str
    target_column: str
    task_type: str = BINARY
    label_transform: LabelTransform = field(default_factory=LabelTransform)
    split_strategy: str = "random"
    split_time_col: str | None = None
    #: How a random split is drawn: by a digest of the key, for tables of any size, or "fixed": by the fixed generator's order of the rows as they are numbered.
    shuffle: str = "hash"
    train: int = 70
    val: int = 15
    inference_mode: str = "row_based"
    inference_filters: tuple[InferenceFilter, ...] = ()
    inference_agg: str = "none"
    entity_refs: tuple[tuple[str, str], ...] = ()

    @property
    def output_dim(self) -> int:
        return self.label_transform.output_dim

    def canonical(self) -> str:
        t = self.label_transform
        label = {
            "threshold": f"thr:{t.threshold:g}{'>=' if t.inclusive else '>'}", "identity": "id", "normalize": "nrm",
            "buckets": "bkt:" + "".join(f"{b:g}," for b in t.bounds),
        }[t.kind]
        return "|".join([self.target_table, self.target_column, _TASKS[self.task_type], label, _SPLITS[self.split_strategy]])

    def fingerprint(self) -> str:
        """A 64-bit xor-multiply hash of the canonical form, in hexadecimal."""
        h = 5381
        for byte in self.canonical().encode():
            h = (h * 33 & (1 << 64) - 1) ^ byte
        return f"{h:x}"


def build_split(table: Table, spec: TaskSpec, key: str) -> tuple[DataFrame, TaskSpec]:
    """(rows with label and split, the spec with its transform fitted on the training rows).

    Rows without a label, or under a temporal split without a time, are in no split. `key` makes the order of rows total.
    """
    if not table.has_column(spec.target_column):
        raise KeyError(f"table {spec.target_table} has no column {spec.target_column}")
    if table.types[spec.target_column] is not LogicalType.NUMERICAL:
        raise TypeError(f"the target {spec.target_column} must be NUMERICAL")
    rows = table.df.where(F.col(spec.target_column).isNotNull())
    if spec.split_strategy == "temporal":
        time = spec.split_time_col or table.time_col
        if not time:
            raise ValueError(f"a temporal split of {spec.target_table} needs a time column")
        rows = splits.temporal(rows, time, key, spec.train, spec.val)
    elif spec.shuffle == "fixed":
        # Only rows with a label are shuffled, in the order of the table's nodes, or else of its key.
        rows = splits.by_permutation(rows.withColumn("_at", F.col(NODE)), ["_at"], train=spec.train, val=spec.val).withColumnRenamed("_at", NODE) if NODE in rows.columns else splits.by_permutation(rows, [key], train=spec.train, val=spec.val)
    else:
        rows = splits.by_hash(rows, key, train=spec.train, val=spec.val)
    fitted = spec.label_transform.fitted(rows.where("split = 'train'"), spec.target_column)
    return rows.withColumn("label", fitted.apply(F.col(spec.target_column))), replace(spec, label_transform=fitted)
