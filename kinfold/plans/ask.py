"""Questions in plain language: a language model, given as a function, turns them into tasks and phrases the answers."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinfold.functions.labels import LabelTransform
from kinfold.operators.inference import InferenceFilter, apply_inference
from kinfold.plans.model import Config, Model, prepare, train
from kinfold.plans.task import BINARY, MULTICLASS, REGRESSION, TaskSpec, build_split
from kinfold.schema import Database
from kinfold.sources.shared import delete, exists

log = logging.getLogger(__name__)
#: (system prompt, message) to reply.
Speaker = Callable[[str, str], str]
SHOWN = 10

RULES = """You turn a question about the database below into one JSON object, and nothing else.
Keys: target_table, target_column (the column to predict), task_type (binary_classification, regression or
multiclass_classification), label_transform {kind: threshold (threshold, inclusive), normalize, identity or buckets (buckets)},
split_strategy (temporal if rows have a time, else random), inference_mode (row_based, or entity_synthesis for a
combination that has no row, with entity_refs {foreign key column of the target table: key as text}), inference_filters [{column, op, value as text}] with op one of
= != >= > <= <, and inference_agg (none, mean, fraction or count). Use only tables and columns that are listed."""


# The keys of the JSON objects that stand for tables.
def schema_json(db: Database) -> str:
    out = []
    for t in db.tables.values():
        fks = {fk.column: fk.target for fk in t.fks}
        columns = [{"name": c, "type": k.value.lower()} | ({"pk": True} if c == t.pk else {}) | ({"fk_to": fks[c]} if c in fks else {}) for c, k in t.types.items()]
        entry: dict = {"table": t.name, "columns": columns}
        if t.pk:
            entry["pkey_col"] = t.pk
        if t.time_col:
            entry["time_col"] = t.time_col
        if fks:
            entry["foreign_keys"] = [{"column": c, "references": x} for c, x in fks.items()]
        out.append(entry)
    return json.dumps(out, indent=2)


def unfenced(reply: str) -> str:
    """The inside of the reply's code fence, if it has one."""
    if "```" not in reply:
        return reply
    inner = reply[reply.index("```") + 3 :]
    inner = inner.split("\n", 1)[1] if "\n" in inner else inner
    return inner.rsplit("```", 1)[0] if "```" in inner else inner


def decode(reply: str, db: Database) -> TaskSpec:
    """The task of a reply; unknown tables, columns and kinds, and filters without all three keys, raise ValueError."""
    try:
        j = json.loads(unfenced(reply))
    except json.JSONDecodeError as e:
        raise ValueError(f"the reply is not JSON: {e}\n{reply}") from e
    try:
        table, column, task, label = j["target_table"], j["target_column"], j["task_type"], j["label_transform"]
        kind = label["kind"]
    except (KeyError, TypeError) as e:
        raise ValueError(f"the reply lacks {e}\n{reply}") from e
    if not db.has_table(table):
        raise ValueError(f"unknown table {table}")
    t = db.get_table(table)
    if not t.has_column(column):
        raise ValueError(f"unknown column {column} in {table}")
    if task not in (BINARY, REGRESSION, MULTICLASS):
        raise ValueError(f"unknown task_type {task}")
    if kind == "threshold":
        transform = LabelTransform("threshold", float(label["threshold"]), bool(label.get("inclusive", True)))
    elif kind in ("identity", "normalize"):
        transform = LabelTransform("normalize" if task == REGRESSION else "identity")
    elif kind == "buckets":
        transform = LabelTransform("buckets", bounds=tuple(float(b) for b in label["buckets"]))
    else:
        raise ValueError(f"unknown label_transform {kind}")
    mode = "entity_synthesis" if j.get("inference_mode") == "entity_synthesis" else "row_based"
    filters, agg, refs = [], "none", ()
    if mode == "row_based":
        for f in j.get("inference_filters", []):
            if not all(k in f for k in ("column", "op", "value")):
                raise ValueError(f"a filter needs column, op and value: {json.dumps(f)}\n{reply}")
            filters.append(InferenceFilter(str(f["column"]), str(f["op"]), str(f["value"])))
        agg = j.get("inference_agg", "none")
        agg = agg if agg in ("mean", "fraction", "count") else "none"
    elif isinstance(j.get("entity_refs"), dict):
        refs = tuple((str(k), str(v)) for k, v in j["entity_refs"].items())
    temporal = j.get("split_strategy") == "temporal"
    return TaskSpec(table, column, task, transform, "temporal" if temporal else "random", t.time_col if temporal else None, inference_mode=mode, inference_filters=tuple(filters), inference_agg=agg, entity_refs=refs)


@dataclass
class Registry:
    """Weights of trained tasks by fingerprint and size, in a local folder ($KINFOLD_HOME or ~/.kinfold) or, by a URI and a session, in any store that Spark writes."""

    folder: Path | str = field(default_factory=lambda: os.environ.get("KINFOLD_HOME") or Path.home() / ".kinfold")
    spark: SparkSession | None = None

    def path(self, spec: TaskSpec, config: Config) -> Path | str:
        name = f"{spec.fingerprint()}-{config.channels}-{config.layers}-{config.hidden}.npz"
        return f"{str(self.folder).rstrip('/')}/{name}" if self.remote else Path(self.folder) / name

    @property
    def remote(self) -> bool:
        return "://" in str(self.folder)

    def has(self, spec: TaskSpec, config: Config) -> bool:
        path = self.path(spec, config)
        return exists(self.spark, path) if self.remote else path.exists()

    def remove(self, spec: TaskSpec, config: Config) -> None:
        path = self.path(spec, config)
        if self.remote:
            delete(self.spark, path)
        else:
            path.unlink(missing_ok=True)


def read_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and quotes around values are dropped."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and key and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


class Session:
    """ask() trains a model for a question, or takes the one it has or finds stored, and answers."""

    def __init__(self, spark: SparkSession, db: Database, speaker: Speaker, config: Config | None = None, registry: Registry | None = None) -> None:
        self.spark, self.db, self.speaker = spark, db, speaker
        self.config, self.registry = config or Config(), registry or Registry()
        self.models: dict[str, Model] = {}

    def intent(self, spec: TaskSpec) -> str:
        if spec.fingerprint() in self.models:
            return "infer"
        return "load" if self.registry.has(spec, self.config) else "train"

    def model(self, spec: TaskSpec) -> Model:
        what, key = self.intent(spec), spec.fingerprint()
        log.info("%s on %s.%s: %s", spec.task_type, spec.target_table, spec.target_column, what)
        if what == "train":
            self.models[key] = train(self.spark, spec, self.db, self.config)
            if not self.registry.remote:
                Path(self.registry.folder).mkdir(parents=True, exist_ok=True)
            self.models[key].save(str(self.registry.path(spec, self.config)))
        elif what == "load":
            model = prepare(self.db, spec, self.config)
            target = model.db.get_table(spec.target_table)
            model.spec = build_split(target, spec, target.pk or "_nid")[1]
            model.load(str(self.registry.path(spec, self.config)))
            self.models[key] = model
        return self.models[key]

    def infer(self, spec: TaskSpec) -> DataFrame | float:
        model = self.model(spec)
        if spec.inference_mode == "entity_synthesis":
            return model.synthesize(dict(spec.entity_refs))
        return apply_inference(model.predict(), list(spec.inference_filters), spec.inference_agg)

    def ask(self, question: str) -> str:
        spec = decode(self.speaker(f"{RULES}\n\n{schema_json(self.db)}", question), self.db)
        return self.speaker("Answer the question in a sentence or two from the result given.", f"Question: {question}\n{self.context(spec, self.infer(spec))}")

    def context(self, spec: TaskSpec, result: DataFrame | float) -> str:
        """What the answer is phrased from: a value, or the first rows and how many more there are."""
        what = f"Task: {spec.task_type} of {spec.target_table}.{spec.target_column}"
        if isinstance(result, float):
            return f"{what}\nPrediction for {dict(spec.entity_refs)}: {result:.4f}"
        if spec.inference_agg != "none":
            row = result.first()
            return f"{what}\n{spec.inference_agg} over {row['n_rows']} rows: " + ("none" if row["value"] is None else f"{row['value']:.4f}")
        rows, n = result.limit(SHOWN).collect(), result.count()
        lines = [", ".join(f"{k}={v}" for k, v in r.asDict().items() if k != "_nid") for r in rows]
        return "\n".join([what, *lines, *([f"... and {n - SHOWN} more"] if n > SHOWN else [])])
