"""Run governance over event logs: cost, completeness, acknowledgements, roll-up, gate, routing, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import scalars as S

#: Reasons by axis.
REASONS = {"non_determinism": "non_determinism_high", "oracle": "oracle_below_threshold", "cost": "cost_budget_exceeded", "trajectory": "trajectory_incomplete", "hitl": "hitl_pending_ack"}
#: Thresholds where a configuration says nothing.
DEFAULTS = {"nd_max": 0.15, "min_score": 0.85, "tokens_max": 10.0**9, "seconds_max": 1e12, "power_wh_max": 1e12}


def run_cost(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Tokens, seconds and Wh of each run of ``runs`` (run_id, wall_seconds, cost_mode, model)."""
    num = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    sums = events.filter("event_type = 'cost_increment'").groupBy("run_id").agg(num("tokens_delta").alias("t"), num("seconds_delta").alias("s"), num("power_wh_delta").alias("w"))
    both = runs.join(sums, "run_id", "left")
    tokens, seconds, power = (F.coalesce(c, F.lit(0)) for c in ("t", "s", "w"))
    seconds = F.when(seconds <= 0, F.col("wall_seconds")).otherwise(seconds)
    power = F.when(F.col("cost_mode") == "fallback", 0.0).when((F.col("cost_mode") == "full") & (power == 0) & (tokens > 0), S.power_estimate(F.col("model"), tokens, F.col("cost_mode"))).otherwise(power)
    return both.select("run_id", "cost_mode", tokens.cast("bigint").alias("tokens"), F.bround(seconds.cast("double"), 3).alias("seconds"), F.bround(power.cast("double"), 6).alias("power_wh"))


def step_gaps(events: DataFrame) -> DataFrame:
    """(run_id, step_id, starts, ends) of steps that began more often than they ended."""
    ends = F.count_if(F.col("event_type").isin("step_finished", "step_aborted"))
    per = events.filter("step_id is not null and step_id <> ''").groupBy("run_id", "step_id").agg(F.count_if(F.col("event_type") == "step_started").alias("starts"), ends.alias("ends"))
    return per.filter("starts > ends")


def hitl_counts(events: DataFrame) -> DataFrame:
    """(run_id, requested, acked, required) of each run."""
    out = events.groupBy("run_id").agg(F.count_if(F.col("event_type") == "hitl_request").alias("requested"), F.count_if(F.col("event_type") == "hitl_ack").alias("acked"))
    return out.withColumn("required", F.col("requested") > 0)


def run_rollup(events: DataFrame, order: str = "seq") -> DataFrame:
    """Last start, measurement and finish of each run; runs without a start are left out."""
    row = F.struct(*events.columns)
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, row), F.when(F.col("event_type") == kind, F.col(order))).alias(kind)
    return events.groupBy("run_id").agg(last("run_started"), last("governance_measurement"), last("run_finished")).filter("run_started is not null")


def first_measurement(events: DataFrame, order: str = "seq") -> DataFrame:
    kind = events.filter("event_type = 'governance_measurement'")
    return kind.groupBy("run_id").agg(F.min_by(F.struct(*events.columns), order).alias("m")).select("m.*")


def merged_thresholds(*levels: dict) -> dict:
    """Deep merge of threshold trees; later levels win key by key."""
    out: dict = {}
    for level in levels:
        for k, v in (level or {}).items():
            out[k] = merged_thresholds(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve_thresholds(rows: DataFrame) -> DataFrame:
    """The deep merge as rows: of (target, path, value, priority) the value of highest priority for each target and path."""
    return rows.groupBy("target", "path").agg(F.max_by("value", "priority").alias("value"))


def gate(measured: DataFrame) -> DataFrame:
    """Adds violated (axes), next_action and reasons to measurements.

    Columns: non_determinism, trajectory_complete, oracle_score, mode, tokens, seconds, power_wh, required,
    requested, acked, and thresholds nd_max, min_score, tokens_max, seconds_max, power_wh_max (missing or,
    for costs, zero: the default).
    """
    have = set(measured.columns)

    def limit(name: str, zero_is_missing: bool) -> Column:
        c = F.col(name).cast("double") if name in have else F.lit(None).cast("double")
        return F.coalesce(F.nullif(c, F.lit(0.0)) if zero_is_missing else c, F.lit(DEFAULTS[name]))

    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    breach = (zero("tokens") > limit("tokens_max", True)) | (zero("seconds") > limit("seconds_max", True)) | ((F.coalesce("mode", F.lit("fallback")) == "full") & (zero("power_wh") > limit("power_wh_max", True)))
    axes = [
        ("non_determinism", zero("non_determinism") > limit("nd_max", False)), ("trajectory", ~F.coalesce("trajectory_complete", F.lit(False))),
        ("oracle", zero("oracle_score") < limit("min_score", False)), ("cost", breach),
        ("hitl", F.coalesce("required", F.lit(False)) & (zero("acked") < zero("requested"))),
    ]
    violated = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in axes]), lambda x: x.isNotNull())
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    out = measured.withColumn("violated", violated)
    return out.withColumn("next_action", F.when(F.size("violated") == 0, "proceed").otherwise("escalate_hitl")).withColumn("reasons", F.transform("violated", lambda a: F.element_at(reason, a)))


def route(intents: DataFrame, triggers: list[dict], text: str = "text") -> DataFrame:
    """Best trigger of each intent: most matched characters, then priority, then list order; null if none matches.

    A trigger: id, priority, phrases (keywords, aliases and intents). One row-wise expression, no join.
    """
    low, best = F.lower(F.coalesce(text, F.lit(""))), None
    options = []
    for at, t in enumerate(triggers):
        chars = sum((F.when(F.contains(low, F.lit(p.lower())), len(p)).otherwise(0) for p in t["phrases"]), F.lit(0))
        options.append(F.struct(chars.alias("chars"), F.lit(int(t.get("priority", 0))).alias("priority"), F.lit(-at).alias("at"), F.lit(t["id"]).alias("id")))
    best = F.array_max(F.array(*options))
    return intents.withColumn("_best", best).withColumn("route", F.when(F.col("_best.chars") > 0, F.col("_best.id"))).withColumn("matched_chars", F.col("_best.chars")).drop("_best")


def repeated_ids(rows: DataFrame, id_: str, place: str) -> DataFrame:
    """(id, n, place): a row for each place of the ids that have several; places are never gathered."""
    several = rows.groupBy(id_).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(several, id_).select(id_, "n", place)


def without_siblings(rows: DataFrame, place: str) -> DataFrame:
    """``rows`` without YAML files beside which a Turtle file of the same name lies: that one speaks for both."""
    stem = lambda c: F.regexp_replace(c, r"\.(ttl|ya?ml)$", "")
    written = rows.filter(F.col(place).endswith(".ttl")).select(stem(F.col(place)).alias("_stem")).distinct()
    yaml = F.col(place).rlike(r"\.ya?ml$")
    return rows.withColumn("_stem", F.when(yaml, stem(F.col(place)))).join(written, "_stem", "left_anti").drop("_stem")


def resolve_first(candidates: DataFrame, id_: str = "id", priority: str = "priority") -> DataFrame:
    """Of the candidates of an id that of the smallest priority number; of equals that of the smallest other columns."""
    rest = F.struct(*[c for c in candidates.columns if c != id_])
    return candidates.groupBy(id_).agg(F.min(F.struct(F.col(priority).alias("p"), rest.alias("c"))).alias("m")).select(id_, "m.c.*")


def missing_paths(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("path").distinct(), "path", "left_anti")


def policy_match(paths: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Adds ``policy``: the first glob that fits, or null."""
    found = F.lit(None).cast("string")
    for g in reversed(globs):
        found = F.when(F.col(path).rlike(S.glob_regex(g)), g).otherwise(found)
    return paths.withColumn("policy", found)


def payload_paths(payload: Column) -> Column:
    """Paths that a tool call names: its path fields, then those in its command."""
    fields = [F.get_json_object(payload, f"$.{k}") for k in ("file_path", "path", "notebook_path")]
    command = F.regexp_extract_all(F.coalesce(F.get_json_object(payload, "$.command"), F.lit("")), F.lit(r"([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+)"), 1)
    return F.array_distinct(F.concat(F.filter(F.array(*fields), lambda x: x.isNotNull()), command))


def contract_violations(workflows: DataFrame) -> DataFrame:
    """(id, rule) of workflow records (id, version, category, kind, mode, status, tool, pipeline) that break the contract."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rules = [F.when(~filled(c), F.lit(f"missing:{c}")) for c in ("id", "version", "category", "kind", "mode")]
    rules.append(F.when(filled("mode") & ~F.col("mode").isin("dry-run", "apply", "validate-only"), F.lit("enum:mode")))
    rules.append(F.when(filled("kind") & ~F.col("kind").isin("single", "pipeline"), F.lit("enum:kind")))
    rules.append(F.when((F.col("kind") == "single") & ~filled("tool"), F.lit("single_needs_tool")))
    rules.append(F.when((F.col("kind") == "pipeline") & (F.size(F.coalesce("pipeline", F.array().cast("array<string>"))) == 0), F.lit("pipeline_needs_steps")))
    return workflows.select("id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))


def classify_manifest(expected: DataFrame, disk: DataFrame) -> DataFrame:
    """Expected entries (path, kind, marker) against disk (path, is_dir, content): action and reason."""
    both = expected.join(disk, "path", "left")
    absent = F.col("is_dir").isNull()
    marked = F.coalesce(F.col("marker").isNotNull() & F.contains(F.coalesce("content", F.lit("")), F.coalesce("marker", F.lit(""))), F.lit(False))
    action = F.when(absent, "create").when(F.col("kind") == "dir", F.when(F.col("is_dir"), "keep").otherwise("conflict")).when(F.col("kind") == "file_empty", "keep").when(marked, "keep").otherwise("conflict")
    reason = F.when(~absent & (F.col("kind") == "dir") & ~F.col("is_dir"), "non_directory_at_dir_path").when(~absent & ~F.col("kind").isin("dir", "file_empty") & ~marked, "non_generated_file_exists")
    return both.select("path", "kind", action.alias("action"), reason.alias("reason"))


def missing_directories(required: DataFrame, dirs: DataFrame) -> DataFrame:
    return required.join(dirs.select("path").distinct(), "path", "left_anti")


def weighted_score(flags: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``score``: the sum of the weights whose flag column is true."""
    total = sum((F.when(F.coalesce(k, F.lit(False)), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return flags.withColumn("score", F.bround(total, 3))


#: Weights of the repository score.
SETUP_WEIGHTS = (0.20, 0.20, 0.15, 0.15, 0.10, 0.10, 0.10)


def retention(slots: DataFrame, now: Column, archive_days: int = 7, drop_days: int = 30) -> DataFrame:
    """Adds ``action`` to run slots (closed, archived, modified): archive, drop or keep."""
    age = S.age_days(F.col("modified"), now)
    return slots.withColumn("action", F.when(F.col("archived") & (age > drop_days), "drop").when(F.col("closed") & ~F.col("archived") & (age > archive_days), "archive").otherwise("keep"))


def upsert_modules(existing: DataFrame, own: DataFrame, id_: str = "id") -> DataFrame:
    """Others stay, own are replaced by id."""
    return existing.join(own.select(id_).distinct(), id_, "left_anti").unionByName(own)


def run_oracle(registry: dict, name: str, *args) -> dict:
    """score, passed, details of a registered oracle: absent is skipped with 1.0, an error scores 0.0."""
    if name not in registry:
        return {"score": 1.0, "passed": True, "details": "skipped"}
    try:
        score = float(registry[name](*args))
        return {"score": score, "passed": score >= 0.85, "details": name}
    except Exception as e:  # noqa: BLE001 - an oracle that fails must not end the run
        return {"score": 0.0, "passed": False, "details": str(e)}


def next_steps(runs: DataFrame, flows: DataFrame, events: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """(run_id, step_id, tool, action, attempt, reason): what each run should do next, from its events so far.

    ``runs`` (run_id, workflow_id), ``flows`` (id, kind, tool, pipeline, max_retry), ``tools`` (tool): those that are
    there, all of them if not given. Actions: ``start`` and ``retry`` a step, ``wait`` for one that runs, ``ask`` a person
    when the tries of a step are used up, ``waiting`` for that person, ``stop`` after a failure, ``abort`` without a
    tool's name, ``finish``. Steps whose tool is not there are passed over. Runs of unknown workflows have no row.
    """
    single = F.array(F.struct(F.lit("step").alias("step_id"), F.col("tool").alias("tool")))
    todo = F.when(F.col("kind") == "pipeline", F.transform("pipeline", lambda s: F.struct(s["step_id"].alias("step_id"), s["tool"].alias("tool")))).otherwise(single)
    most = F.when(F.coalesce("max_retry", F.lit(0)) == 0, 1).otherwise(F.col("max_retry")).alias("most")
    known = flows.select(F.col("id").alias("workflow_id"), most, F.posexplode_outer(todo).alias("at", "s"))
    steps = runs.select("run_id", "workflow_id").join(known, "workflow_id").select("run_id", "most", "at", "s.tool", F.coalesce("s.step_id", "s.tool", F.when(F.col("s").isNotNull(), "step")).alias("step_id"))
    if tools is None:
        steps = steps.withColumn("there", F.lit(True))
    else:
        steps = steps.join(tools.select("tool").distinct().withColumn("there", F.lit(True)), "tool", "left")
    of = lambda kind: F.col("event_type") == kind
    told = events.filter("step_id is not null").groupBy("run_id", "step_id").agg(
        F.max(F.when(of("step_started"), F.col("attempt"))).alias("tries"), F.max(F.when(of("step_finished"), F.struct("attempt", "exit_code"))).alias("ended"), F.count_if(of("hitl_request")).alias("asked")
    )
    steps = steps.join(told, ["run_id", "step_id"], "left")
    tries, code = F.coalesce("tries", F.lit(0)), F.col("ended.exit_code")
    over = F.coalesce(F.col("ended.attempt") >= tries, F.lit(False))
    action = (
        F.when(F.col("at").isNull(), "done").when(F.col("tool").isNull(), "abort").when(F.col("there").isNull(), "done").when(tries == 0, "start").when(~over, "wait").when(code == 0, "done")
        .when(S.retryable(code) & (tries <= F.col("most")), "retry").when(S.retryable(code) & (F.col("asked") == 0), "ask").when(S.retryable(code), "waiting").otherwise("stop")
    )
    reason = F.when(action == "abort", "missing_tool_field").when(action == "ask", "retry_budget_exhausted").when(action == "stop", F.concat(F.lit("exit code "), code.cast("string")))
    attempt = F.when(action.isin("start", "retry"), tries + 1).when(action.isin("wait", "ask", "waiting", "stop"), tries)
    each = steps.select("run_id", F.when(action != "done", F.struct("at", "step_id", "tool", action.alias("action"), attempt.cast("int").alias("attempt"), reason.alias("reason"))).alias("next"))
    first = each.groupBy("run_id").agg(F.min("next").alias("n"))
    return first.select("run_id", "n.step_id", "n.tool", F.coalesce("n.action", F.lit("finish")).alias("action"), "n.attempt", "n.reason")
