"""YAML files: definitions, roles, instances and workflows.

Files are read by Spark as whole texts, so any store that Spark can read works. Instances and workflows may be
many: their files are parsed where they lie. Definitions and roles are an ontology's own files, whose content
becomes rules of the plan: they come to the driver, at most MOST of them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.files import _matches

MOST = 10_000
_INSTANCE = "id string, instance_of string, slots map<string,array<string>>"
_STEP = "struct<step_id:string,tool:string,action:string>"
WORKFLOW = (
    "id string, version string, category string, kind string, mode string, status string, tool string, hitl_required boolean, max_retry int, oracle string, oracle_threshold double, "
    f"tokens_max double, seconds_max double, power_wh_max double, pipeline array<{_STEP}>, layered boolean, blocks map<string,string>"
)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    if not _matches(spark, path):
        return spark.createDataFrame([], "file string, stem string, text string")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return whole.select("file", F.regexp_replace(F.substring_index("file", "/", -1), r"\.ya?ml$", "").alias("stem"), "text")


def load_yaml(text: str | None) -> dict:
    """The mapping of a YAML text; an empty text, or one that holds no mapping, is an empty mapping."""
    import yaml

    found = yaml.safe_load(text or "")
    return found if isinstance(found, dict) else {}


def read_yaml(spark: SparkSession, path: str) -> dict[str, dict]:
    """Documents by file stem, in order of stems; an unreadable file raises and names itself."""
    rows = _texts(spark, path).orderBy("stem").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} files at {path}")
    out = {}
    for r in rows:
        try:
            out[r.stem] = load_yaml(r.text)
        except Exception as e:
            raise ValueError(f"{r.file}: {e}") from e
    return out


def namespace_of(document: dict, fallback: dict | None = None) -> str | None:
    """IRI of a document's default prefix, else that of ``fallback``'s."""
    for d in (document, fallback or {}):
        value = (d.get("prefixes") or {}).get(d.get("default_prefix"))
        if isinstance(value, dict):
            value = value.get("prefix_reference")
        if value:
            return value
    return None


def _plain(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """file, stem, prefixes (JSON), id, instance_of, slots of the instances in YAML files; every value becomes a list of texts."""

    def run(batches):
        for pdf in batches:
            out = []
            for file, stem, text in zip(pdf["file"], pdf["stem"], pdf["text"]):
                doc = load_yaml(text)
                head = json.dumps({k: doc[k] for k in ("default_prefix", "prefixes") if k in doc})
                for key, body in (doc.get("instances") or {}).items():
                    body = body or {}
                    slots = {str(k): [_plain(x) for x in (v if isinstance(v, list) else [v])] for k, v in body.items() if k != "instance_of"}
                    out.append((file, stem, head, str(key), _plain(body.get("instance_of")), slots))
            yield pd.DataFrame(out, columns=["file", "stem", "head", "id", "instance_of", "slots"])

    return _texts(spark, path).mapInPandas(run, f"file string, stem string, head string, {_INSTANCE}")


def workflow_of(text: str | None) -> tuple:
    """Fields of a workflow: those of ``x_msm``, then of ``module``, then of the top level; a step without an id keeps none."""
    doc = load_yaml(text)
    own, module = doc.get("x_msm"), doc.get("module")
    own, module = own if isinstance(own, dict) else {}, module if isinstance(module, dict) else {}

    def field(name: str, *places: dict):
        for place in (*places, doc):
            if place.get(name) is not None and not isinstance(place[name], dict | list):
                return _plain(place[name])
        return None

    def number(value, kind, default=None):
        try:
            return kind(value)
        except (TypeError, ValueError):
            return default

    source = own or doc
    rules, budget = source.get("governance") or {}, source.get("cost_budget") or (source.get("governance") or {}).get("cost_budget") or {}
    steps = [{k: _plain(s.get(k)) for k in ("step_id", "tool", "action")} for s in source.get("pipeline") or [] if isinstance(s, dict)]
    blocks = {k: json.dumps(v, sort_keys=True, default=str) for k, v in doc.items() if isinstance(v, dict)}
    return (
        field("id", module), field("version", module), field("category", own), field("kind", own), field("mode", own), field("status", own, module), field("tool", own),
        None if rules.get("hitl_required") is None else str(rules["hitl_required"]).lower() == "true", number(rules.get("max_retry"), int), _plain(rules.get("oracle")), number(rules.get("oracle_threshold"), float),
        *(number(budget.get(k), float) for k in ("tokens", "seconds", "power_wh")), steps, bool(own), blocks,
    )


def read_workflows(spark: SparkSession, path: str) -> DataFrame:
    """file and the fields (WORKFLOW) of every workflow file."""
    names = [f.split(" ")[0] for f in WORKFLOW.replace(f"array<{_STEP}>", "x").split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(f, *workflow_of(t)) for f, t in zip(pdf["file"], pdf["text"])], columns=["file", *names])

    return _texts(spark, path).mapInPandas(run, f"file string, {WORKFLOW}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, path) of workflow index files (a ``workflows`` list), ordered by id."""

    def run(batches):
        for pdf in batches:
            rows = [w for t in pdf["text"] for w in load_yaml(t).get("workflows") or [] if isinstance(w, dict)]
            yield pd.DataFrame([(_plain(w.get("id")), _plain(w.get("path"))) for w in rows], columns=["id", "path"])

    return _texts(spark, path).mapInPandas(run, "id string, path string").orderBy("id")
