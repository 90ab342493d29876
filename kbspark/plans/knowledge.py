"""More of the core library's queries: files written and read again, findings, gates, compiling, streams.

Files lie in the folder that driver and executors share. As in the catalogue, each query states how it reads
the driver's tables as a knowledge base.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.functions import sql as fsql
from kbspark.operators import archive, compile as comp, evidence, governance, lifting, maintain, materialise, provenance, reasoning, registry
from kbspark.operators.reasoning import Rules, shared_path
from kbspark.plans.catalogue import CHUNKS_SQL, query, table
from kbspark.sinks import notes
from kbspark.sources import files, python_sources, yaml_files
from kbspark.streaming import runs, schedule

_NONE = "array<string>"


def _text(df, spark, name, one=False):
    """A text column written as lines; the path."""
    path = shared_path(spark, name)
    (df.coalesce(1) if one else df).write.text(path)
    return path


def _null(kind="string"):
    return F.lit(None).cast(kind)


# --- files --------------------------------------------------------------------------------------------


@query("jsonl_tolerant_scan", "select doc_id, lang, source from documents where doc_id % 10 <> 3")
def jsonl_tolerant_scan(spark, sf_dir):
    """Documents as JSON lines, every tenth of them cut off: bad lines are dropped."""
    line = F.to_json(F.struct("doc_id", "lang", "source"))
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 5)).otherwise(line).alias("value"))
    return files.read_jsonl(spark, _text(rows, spark, "lines"), "doc_id long, lang string, source string").filter("doc_id is not null")


@query("jsonl_append_overwrite", "select s_suppkey, s_name from supplier where s_nationkey < 5 or s_nationkey >= 20")
def jsonl_append_overwrite(spark, sf_dir):
    """Rows that are overwritten, then appended to, read again without tolerance."""
    s, path = table(spark, sf_dir, "supplier"), shared_path(spark, "records")
    notes.overwrite_jsonl(s.select("s_suppkey", "s_name"), path)
    notes.overwrite_jsonl(s.filter("s_nationkey < 5").select("s_suppkey", "s_name"), path)
    notes.append_jsonl(s.filter("s_nationkey >= 20").select("s_suppkey", "s_name"), path)
    return files.read_jsonl(spark, path, "s_suppkey long, s_name string", "FAILFAST")


def _in_small_splits(spark, read, size="4k"):
    """``read()`` with files cut into splits of about ``size``; the setting is put back."""
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        return reasoning.saved(read(), "read")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query(
    "jsonl_numbered_scan",
    """with l as (select c_custkey, c_name, row_number() over (order by c_custkey) as line_no from customer)
       select line_no::int as line_no, case when c_custkey % 4 = 1 then null else c_name end as name, case when c_custkey % 4 = 1 then 'line ' || line_no || ': invalid JSON' end as failure from l""",
)
def jsonl_numbered_scan(spark, sf_dir):
    """Customers as lines of one file in many splits, every fourth of them broken: line numbers of both kinds."""
    line = F.when(F.col("c_custkey") % 4 == 1, "{broken").otherwise(F.to_json(F.struct(F.col("c_name").alias("name"))))
    path = _text(table(spark, sf_dir, "customer").orderBy("c_custkey").select(line.alias("value")), spark, "lines", one=True)

    def read():
        rows, bad = files.read_jsonl_numbered(spark, f"{path}/part-*", "name string")
        return rows.select(F.col("line_no").cast("int"), "name", _null().alias("failure")).unionByName(bad.select(F.col("line_no").cast("int"), _null().alias("name"), "failure"))

    return _in_small_splits(spark, read)


@query("sources_list_scan", "select (2 * row_number() over (order by s_suppkey))::int as ordinal, 'http://s.org/' || s_suppkey as uri from supplier")
def sources_list_scan(spark, sf_dir):
    """A list file of suppliers: a comment before every source, blanks around it."""
    s = table(spark, sf_dir, "supplier").orderBy("s_suppkey")
    lines = s.select(F.explode(F.array(F.lit("# supplier"), F.concat(F.lit("  http://s.org/"), "s_suppkey", F.lit(" ")))).alias("value"))
    return files.read_sources_list(spark, f"{_text(lines, spark, 'list', one=True)}/part-*").select(F.col("ordinal").cast("int"), "uri")


@query("directory_scan", "select 'n_regionkey=' || n_regionkey as folder, 1::bigint as files from nation group by n_regionkey")
def directory_scan(spark, sf_dir):
    """Nations as one file for each region."""
    path = shared_path(spark, "tree")
    table(spark, sf_dir, "nation").coalesce(1).write.partitionBy("n_regionkey").csv(path)
    found = files.read_directory(spark, path, "part-*")
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("files"))


@query(
    "graph_json_scan",
    """select 'node' as kind, n_name as a, null as b, null::double as confidence from nation
       union all select 'edge', a.n_name, b.n_name, case when a.n_nationkey % 2 = 0 then 0.5 else 0.7 end from nation a join nation b on b.n_nationkey = a.n_nationkey + 1""",
)
def graph_json_scan(spark, sf_dir):
    """One graph file: nations, each linked to the next; odd links say their confidence as text, which is none."""
    n = table(spark, sf_dir, "nation")
    nodes = n.agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("id"), F.lit("concept").alias("file_type")))).alias("nodes"))
    b = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next"))
    link = F.concat(F.lit('{"from":"'), "n_name", F.lit('","to":"'), "next", F.lit('","confidence":'), F.when(F.col("n_nationkey") % 2 == 0, "0.5").otherwise('"0.5"'), F.lit("}"))
    links = n.join(b, "n_nationkey").agg(F.array_join(F.collect_list(link), ",").alias("links"))
    whole = nodes.crossJoin(links).select(F.concat(F.lit('{"nodes":'), "nodes", F.lit(',"links":['), "links", F.lit("]}")).alias("value"))
    nodes, edges = files.read_graph(spark, _text(whole, spark, "graph"))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), _null().alias("b"), _null("double").alias("confidence")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "confidence"))


_EX = "http://ex.org/"


@query(
    "turtle_round_trip",
    f"""select '{_EX}c' || c_custkey as s, '{_EX}in' as p, '{_EX}n' || c_nationkey as o from customer
        union all select '{_EX}c' || c_custkey, '{_EX}says', c_name || ' "and"' || chr(10) || '\\more' from customer""",
)
def turtle_round_trip(spark, sf_dir):
    """Triples of customers written twice as Turtle and read, in many splits, as one set."""
    c = table(spark, sf_dir, "customer")
    i = F.concat(F.lit(_EX + "c"), "c_custkey")
    row = lambda p, o, kind: c.select(i.alias("s"), F.lit(_EX + p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), _null().alias("o_lang"), _null().alias("o_dt"))
    triples = row("in", F.concat(F.lit(_EX + "n"), "c_nationkey"), "iri").unionByName(row("says", F.concat("c_name", F.lit(' "and"\n\\more')), "literal"))
    lines, path = comp.turtle_lines(triples), shared_path(spark, "turtle")
    lines.coalesce(1).write.text(f"{path}/a")
    lines.write.text(f"{path}/b")
    return _in_small_splits(spark, lambda: python_sources.read_turtle(spark, f"{path}/*/part-*"), "32k").select("s", "p", "o").distinct()


@query(
    "note_frontmatter",
    """select c_custkey, 'c' || c_custkey as entity, 'L' || c_nationkey % 3 as level, case when c_custkey % 2 = 0 then 'part_of' end as relation, '[[n' || c_nationkey || ']]' as target, 'n' || c_nationkey as linked, 'Body.' as body from customer""",
)
def note_frontmatter(spark, sf_dir):
    """Customers as notes with frontmatter; every second has a relation without a type."""
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "type: part_of, ").otherwise("")
    head = F.concat(F.lit("---\nentity: c"), "c_custkey", F.lit("\nlevel: L"), (F.col("c_nationkey") % 3).cast("string"), F.lit("\nrelations:\n  - {"), kind, F.lit("target: '[[n"), "c_nationkey", F.lit("]]'}\n---\nBody."))
    held = c.select("c_custkey", head.alias("text")).select("c_custkey", files.parse_frontmatter(F.col("text")).alias("fm"), S.strip_frontmatter(F.col("text")).alias("body"))
    rel = F.col("fm.relations")[0]
    return held.select("c_custkey", "fm.entity", "fm.level", rel["type"].alias("relation"), rel["target"].alias("target"), S.wikilink_id(rel["target"]).alias("linked"), "body")


@query(
    "archive_sql",
    "select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderkey % 2 = 0 group by 1, 2",
)
def archive_sql(spark, sf_dir):
    """Two exports of orders; SQL over the second's snapshot view."""
    o, path = table(spark, sf_dir, "orders"), shared_path(spark, "snapshots")
    archive.export_snapshot({"orders": o}, path, "20240101_000000")
    archive.export_snapshot({"orders": o.filter("o_orderkey % 2 = 0")}, path, "20240102_000000")
    return archive.query_snapshots(spark, path, "select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from snap_20240102_000000_orders group by 1, 2")


@query("latest_snapshot", "select o_orderkey, o_custkey from orders where o_orderkey % 3 = 0")
def latest_snapshot(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), shared_path(spark, "snapshots")
    archive.export_snapshot({"orders": o}, path, "20240101_000000")
    archive.export_snapshot({"orders": o.filter("o_orderkey % 3 = 0")}, path, "20250101_000000")
    return files.latest_snapshot(spark, path)


@query(
    "yaml_instances_scan",
    """select 'n' || n_nationkey as id, 'Nation' as instance_of, k as slot, v as value from (
       select n_nationkey, 'region' as k, 'r' || n_regionkey as v from nation union all select n_nationkey, 'size', (n_nationkey * 2)::varchar from nation
       union all select n_nationkey, 'seen', 'true' from nation union all select n_nationkey, 'region', 'world' from nation)""",
)
def yaml_instances_scan(spark, sf_dir):
    """Nations as the instances of one YAML file."""
    n = table(spark, sf_dir, "nation")
    entry = F.concat(F.lit("  n"), "n_nationkey", F.lit(": {instance_of: Nation, region: [r"), "n_regionkey", F.lit(", world], size: "), (F.col("n_nationkey") * 2).cast("string"), F.lit(", seen: yes}"))
    whole = n.agg(F.concat(F.lit("instances:\n"), F.array_join(F.collect_list(entry), "\n")).alias("value"))
    rows = yaml_files.read_instances(spark, _text(whole, spark, "abox"))
    return rows.select("id", "instance_of", F.explode("slots").alias("slot", "values")).select("id", "instance_of", "slot", F.explode("values").alias("value"))


def _flows(spark, sf_dir):
    """Nations as workflow files: layered ones and flat ones."""
    n = table(spark, sf_dir, "nation").repartition(5, "n_nationkey")
    k = F.col("n_nationkey").cast("string")
    mode = F.when(F.col("n_nationkey") % 5 == 0, "odd").otherwise("apply")
    layered = F.concat(F.lit("module: {id: w"), k, F.lit(", version: '1'}\nx_msm:\n  category: c\n  kind: pipeline\n  mode: "), mode, F.lit("\n  governance: {max_retry: "), (F.col("n_nationkey") % 4).cast("string"), F.lit("}\n  pipeline:\n  - {step_id: a, tool: t"), k, F.lit("}\n  - {tool: u}\n"))
    flat = F.concat(F.lit("id: w"), k, F.lit("\nversion: '1'\ncategory: c\nkind: single\nmode: "), mode, F.lit("\ntool: "), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("t"), F.lit("\n"))
    path = shared_path(spark, "flows")
    n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, layered).otherwise(flat).alias("value")).write.partitionBy("n_nationkey").text(path)
    return yaml_files.read_workflows(spark, f"{path}/*/part-*")


_MODE = "case when n_nationkey % 5 = 0 then 'odd' else 'apply' end"


@query(
    "yaml_workflow_scan",
    f"""select 'w' || n_nationkey as id, '1' as version, case when n_nationkey % 2 = 0 then 'pipeline' else 'single' end as kind, {_MODE} as mode,
               case when n_nationkey % 2 = 1 and n_nationkey % 3 <> 0 then 't' end as tool, case when n_nationkey % 2 = 0 then (n_nationkey % 4)::int end as max_retry,
               case when n_nationkey % 2 = 0 then 't' || n_nationkey || ',u' else '' end as tools from nation""",
)
def yaml_workflow_scan(spark, sf_dir):
    return _flows(spark, sf_dir).select("id", "version", "kind", "mode", "tool", "max_retry", F.array_join(F.transform("pipeline", lambda s: s["tool"]), ",").alias("tools"))


@query(
    "workflow_contract",
    """select 'w' || n_nationkey as id, 'enum:mode' as rule from nation where n_nationkey % 5 = 0
       union all select 'w' || n_nationkey, 'single_needs_tool' from nation where n_nationkey % 2 = 1 and n_nationkey % 3 = 0""",
)
def workflow_contract(spark, sf_dir):
    return materialise.layered_violations(_flows(spark, sf_dir))


@query("workflow_sync", "select 'missing' as side, '2' as max_retry, count(*) as n from nation where n_nationkey % 4 = 2")
def workflow_sync(spark, sf_dir):
    """Workflows as triples, written without the retries of some, read and compared."""
    triples = reasoning.saved(materialise.workflow_triples(_flows(spark, sf_dir)), "flows")
    lost = F.col("p").endswith("max_retry") & (F.col("o") == "2")
    path = _text(comp.turtle_lines(triples.filter(~lost)).select(F.col("line").alias("value")), spark, "turtle")
    diff = materialise.out_of_sync(triples, python_sources.read_turtle(spark, f"{path}/part-*"))
    return diff.groupBy("side", F.col("o").alias("max_retry")).agg(F.count("*").alias("n"))


@query("workflow_turtle_read", "select 'w' || n_nationkey as id, (case when n_nationkey % 2 = 0 then 2 else 0 end)::int as steps, case when n_nationkey % 2 = 0 then 't' || n_nationkey || ',u' else '' end as tools from nation")
def workflow_turtle_read(spark, sf_dir):
    """Workflow subjects read back from their triples, steps in order."""
    flows = files.workflows_of(materialise.workflow_triples(_flows(spark, sf_dir)))
    tools = F.transform(F.coalesce("pipeline", F.array().cast(_NONE)), lambda s: F.get_json_object(s, "$.tool"))
    return flows.select(F.try_element_at("props", F.lit("id")).alias("id"), F.size(tools).alias("steps"), F.array_join(tools, ",").alias("tools"))


# --- scalar functions ---------------------------------------------------------------------------------


@query(
    "sql_functions",
    """select p_partkey, trim(p_name) as a, 'sha256:' || sha256(p_name) as b, substr(sha256(p_name), 1, 16) as c, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') as d, round_even(p_retailprice / 7, 3) as e from part""",
)
def sql_functions(spark, sf_dir):
    """The library's functions as they are called in SQL."""
    fsql.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("kb_part")
    return spark.sql("select p_partkey, kb_strip(p_name) as a, kb_content_hash(p_name) as b, kb_short_id(p_name) as c, kb_graph_slug(p_name) as d, kb_round(p_retailprice / 7) as e from kb_part")


@query(
    "iri_functions",
    """with i as (select page_id, 'http://x.org/a#' || page_id as iri, regexp_replace(url, '[^A-Za-z0-9._/-]', '_', 'g') as u from pages)
       select page_id, page_id::varchar as local, 'http://x.org/a#' as namespace, 'http://s/' || u as source from i where u is not null""",
)
def iri_functions(spark, sf_dir):
    iri = F.concat(F.lit("http://x.org/a#"), "page_id")
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", S.iri_local(iri).alias("local"), S.iri_namespace(iri).alias("namespace"), S.source_iri("http://s/", F.col("url")).alias("source"))


@query(
    "html_dispatch",
    "select page_id, coalesce(regexp_matches(lower(ltrim(substr(html, 1, 200), ' ' || chr(9) || chr(10) || chr(13))), '^(<!doc|<html)'), false) or page_id % 3 = 0 as is_html from pages where html is not null",
)
def html_dispatch(spark, sf_dir):
    """Every third page says its type."""
    kind = F.when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8")
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", S.is_html(kind, F.col("html")).alias("is_html"))


@query(
    "payload_paths",
    """select event_id, 'a/' || user_id || '.md,src/' || event_type || '/x.py,b/c' as paths from events where event_id % 2 = 0 union all select event_id, 'src/' || event_type || '/x.py,b/c' from events where event_id % 2 = 1""",
)
def payload_paths(spark, sf_dir):
    """Events as tool calls: a path field on every second, a command with two paths on all."""
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a/"), "user_id", F.lit(".md")))
    payload = F.to_json(F.struct(path.alias("file_path"), F.concat(F.lit("cat src/"), "event_type", F.lit("/x.py b/c b/c")).alias("command")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(governance.payload_paths(payload), ",").alias("paths"))


@query(
    "literal_kinds",
    """select event_id, case when k in (0, 1, 2) then 'literal' when k = 3 then 'iri' else 'literal' end as kind from (select event_id, event_id % 5 as k from events)""",
)
def literal_kinds(spark, sf_dir):
    """Booleans, whole and broken numbers, identifiers and texts in turn."""
    k = F.col("event_id") % 5
    v = F.when(k == 0, "true").when(k == 1, F.col("event_id").cast("string")).when(k == 2, F.concat(F.lit("-1."), "event_id", F.lit("e3"))).when(k == 3, F.concat(F.lit("x_"), "event_id")).otherwise("two words")
    return table(spark, sf_dir, "events").select("event_id", S.literal_kind(v).alias("kind"))


@query("retry_predicate", "select event_id, event_id % 100 between 64 and 79 as again from events")
def retry_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.retryable(F.col("event_id") % 100).alias("again"))


@query("template_fill", "select n_nationkey, 'Dear ' || n_name || ' (' || n_regionkey || '), {{OTHER}}' as text from nation")
def template_fill(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.fill_template(F.lit("Dear {{NAME}} ({{REGION}}), {{OTHER}}"), {"NAME": F.col("n_name"), "REGION": F.col("n_regionkey").cast("string")}).alias("text"))


@query("canonical_hash", """select n_nationkey, sha256('{"key": ' || n_nationkey || ', "name": "' || n_name || '", "none": null}') as h from nation""")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.canonical_hash(F.struct(_null().alias("none"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))).alias("h"))


@query(
    "slot_retention",
    """select user_id, case when user_id % 3 = 0 and d > 30 then 'drop' when user_id % 3 = 1 and d > 7 then 'archive' else 'keep' end as action
       from (select user_id, date_diff('second', max(ts), timestamp '2024-02-10 00:00:00') / 86400.0 as d from events group by user_id)""",
)
def slot_retention(spark, sf_dir):
    """Users as run slots, last touched at their last event: a third archived, a third closed."""
    slots = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("modified")).withColumn("archived", F.col("user_id") % 3 == 0).withColumn("closed", F.col("user_id") % 3 == 1)
    return governance.retention(slots, F.lit("2024-02-10 00:00:00").cast("timestamp")).select("user_id", "action")


@query("seen_retries", "select user_id as run_id, (event_id % 20)::varchar as step_id, count(*) as attempts from events where event_type = 'view' group by all having count(*) > 1")
def seen_retries(spark, sf_dir):
    """Attempts of each step: its starts."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    steps = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 20).cast("string").alias("step_id"), F.lit("step_started").alias("event_type"))
    return governance.step_gaps(steps).filter("starts > 1").select("run_id", "step_id", F.col("starts").alias("attempts"))


# --- graphs and evidence ------------------------------------------------------------------------------


def _part_graph(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") > 25, "concept").otherwise("code")
    nodes = p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"), kind.alias("file_type"), F.lit("a/f.md").alias("source_file"), _null().alias("community"), _null().alias("community_name"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("P"), "l_partkey").alias("p"), "l_linenumber")
    following = li.select("l_orderkey", F.col("p").alias("dst"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    edges = li.withColumnRenamed("p", "src").join(following, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "src", "dst", _null().alias("relation"), F.lit(0.6).alias("confidence"), F.lit("a/f.md").alias("source_file"))
    return nodes, edges


_PAIRS = "select a.l_orderkey, a.l_linenumber, a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1"


@query("graph_candidate_edges", f"with e as ({_PAIRS}), c as (select p_partkey from part where p_size > 25) select l_orderkey, l_linenumber, 'P' || src as src, 'P' || dst as dst from e where src in (from c) and dst in (from c)")
def graph_candidate_edges(spark, sf_dir):
    """Parts that follow each other in an order are linked; parts over size 25 are the candidates."""
    nodes, edges = _part_graph(spark, sf_dir)
    return lifting.inner_edges(edges, nodes.filter("file_type = 'concept'"), "id").select("l_orderkey", "l_linenumber", "src", "dst")


@query(
    "graph_lift",
    f"""with e as ({_PAIRS}), c as (select p_partkey, p_name from part where p_size > 25), inner_e as (select src, dst from e where src in (select p_partkey from c) and dst in (select p_partkey from c)),
        deg as (select p_partkey, count(n) as d from c left join (select src as n from inner_e union all select dst from inner_e) on n = p_partkey group by 1),
        hub as (select p_partkey from deg where d > (select avg(d) + 2 * stddev_pop(d) from deg))
        select 'entity' as kind, substr(sha256('graph:P' || p_partkey), 1, 16) as id, 'p' || p_partkey as a, case when p_partkey in (from hub) then 'hub_candidate' else '' end as b, 'graph:a/f.md:' || p_name as span from c
        union all select distinct 'relation', substr(sha256('graph:P' || src || ':P' || dst || ':'), 1, 16), 'p' || src, 'p' || dst, 'graph:a/f.md:P' || src || '→P' || dst from inner_e""",
)
def graph_lift(spark, sf_dir):
    """Entity and relation candidates of the part graph."""
    ents, rels = lifting.lift_graph(*_part_graph(spark, sf_dir))
    out = ents.select(F.lit("entity").alias("kind"), F.col("candidate_id").alias("id"), F.col("entity_id").alias("a"), F.array_join("tags", ",").alias("b"), F.col("evidence_spans")[0].alias("span"))
    return out.unionByName(rels.select(F.lit("relation").alias("kind"), F.col("candidate_id").alias("id"), F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), F.col("evidence_spans")[0].alias("span")).distinct())


@query("chunk_totals", f"{CHUNKS_SQL} select doc_id, source, i::int as chunk_index, total::int as chunk_total from chunks")
def chunk_totals(spark, sf_dir):
    """All chunks of all documents, with their numbers."""
    return evidence.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "chunk_index", "chunk_total")


# --- findings -----------------------------------------------------------------------------------------


def _notes_of(spark, sf_dir):
    """Customers as entities whose notes lie in their segment's directory; some notes have no entity, some entities no note."""
    c = table(spark, sf_dir, "customer")
    path = F.concat("c_mktsegment", F.lit("/c"), "c_custkey", F.lit(".md"))
    ents = c.filter("c_custkey % 7 <> 2").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("cluster"), F.col("c_mktsegment").alias("dir_cluster"), path.alias("md_path"), F.lit("accepted").alias("status"), F.array(F.concat(F.lit("evidence:seed:"), "c_nationkey")).alias("source_refs"))
    md = c.filter("c_custkey % 5 <> 1").select(path.alias("path"), F.col("c_mktsegment").alias("cluster"), F.concat(F.lit("x<s>h"), (F.col("c_custkey") % 4).cast("string"), F.lit("<e>y")).alias("text"))
    return ents, md


_NOTE_PATH = "c_mktsegment || '/c' || c_custkey || '.md'"


@query(
    "drift_notes",
    f"""select 'jsonl_without_md' as kind, c_mktsegment as cluster, 'c' || c_custkey as id, {_NOTE_PATH} as path from customer where c_custkey % 7 <> 2 and c_custkey % 5 = 1
        union all select 'md_without_jsonl', c_mktsegment, null, {_NOTE_PATH} from customer where c_custkey % 7 = 2 and c_custkey % 5 <> 1
        union all select 'evidence_dangling', c_mktsegment, 'c' || c_custkey, 'evidence:seed:' || c_nationkey from customer where c_custkey % 7 <> 2 and c_nationkey >= 20""",
)
def drift_notes(spark, sf_dir):
    ents, md = _notes_of(spark, sf_dir)
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("evidence:seed:"), "n_nationkey").alias("id"))
    return maintain.drift(ents, md.select("path", "cluster"), seeds)


@query(
    "orphan_notes",
    f"""select 'md_orphan' as kind, c_mktsegment as cluster, null as id, {_NOTE_PATH} as path from customer where c_custkey % 7 = 2 and c_custkey % 5 <> 1
        union all select 'seed_orphan', null, null, 'evidence/' || n_nationkey || '.md' from nation where n_nationkey >= 20
        union all select 'no_incoming_relation', c_mktsegment, 'c' || c_custkey, {_NOTE_PATH} from customer where c_custkey % 7 <> 2 and c_custkey not in (select o_custkey from orders)""",
)
def orphan_notes(spark, sf_dir):
    """Orders relate customers; nations are evidence files, the first twenty of them seeds."""
    ents, md = _notes_of(spark, sf_dir)
    rel = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), _null().alias("target"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("evidence/"), "n_nationkey", F.lit(".md")).alias("path"))
    return maintain.orphan_findings(ents, rel, md.select("path", "cluster"), n.select("path"), n.filter("n_nationkey < 20").select(F.col("path").alias("md_path")))


@query("stale_blocks", "select 'c' || c_custkey as id from customer where c_custkey % 7 <> 2 and c_custkey % 5 <> 1 and c_custkey % 4 <> 0")
def stale_blocks(spark, sf_dir):
    """Notes whose block says something else than ``h0``."""
    ents, md = _notes_of(spark, sf_dir)
    return maintain.stale_blocks(ents.withColumn("expected_hash", F.sha2(F.lit("h0"), 256)), md, "<s>", "<e>").select("id")


@query(
    "sorted_findings",
    f"""with f as (select 'md_orphan' as kind, '' as id, {_NOTE_PATH} as path from customer where c_custkey % 3 = 0 union all select 'gone', 'c' || c_custkey, '' from customer where c_custkey % 3 = 1)
        select kind, id, path, (row_number() over (order by kind, id, path) - 1)::int as at from f""",
)
def sorted_findings(spark, sf_dir):
    """Findings in their stable order, with their place in it."""
    c = table(spark, sf_dir, "customer")
    found = c.filter("c_custkey % 3 = 0").select(F.lit("md_orphan").alias("kind"), F.lit("").alias("id"), F.concat("c_mktsegment", F.lit("/c"), "c_custkey", F.lit(".md")).alias("path"))
    found = found.unionByName(c.filter("c_custkey % 3 = 1").select(F.lit("gone").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("").alias("path")))
    return maintain.with_place(maintain.sorted_findings(found))


@query("plan_totals", f"select case when c_custkey % 7 <> 2 then 'create_md_placeholder' else 'human_review' end as action, count(*) as n from customer where (c_custkey % 7 <> 2 and c_custkey % 5 = 1) or (c_custkey % 7 = 2 and c_custkey % 5 <> 1) group by 1")
def plan_totals(spark, sf_dir):
    """What the drift above asks for: placeholders, or a person."""
    ents, md = _notes_of(spark, sf_dir)
    found = maintain.drift(ents.withColumn("source_refs", F.array().cast(_NONE)), md.select("path", "cluster"), spark.createDataFrame([], "id string"))
    return maintain.plan_fixes(found).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "overlap_score",
    """with f as (select p_brand, lower(trim(p_name)) as norm, count(*) as n from part group by 1, 2) select case when max(n) > 1 then 0.0 else 0.25 end::double as labels, 0.25::double as overlap, 0.0::double as evidence, 0.25::double as boundary,
              (case when max(n) > 1 then 0.0 else 0.25 end + 0.5)::double as score from f""",
)
def overlap_score(spark, sf_dir):
    """Parts without evidence, checked for equal labels; a Jaccard bound that no pair reaches."""
    p = table(spark, sf_dir, "part")
    ents = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("cluster"), F.col("p_name").alias("label"), F.array().cast(_NONE).alias("synonyms"), F.array().cast(_NONE).alias("source_refs"), F.lit("x").alias("md_path"), F.col("p_partkey").alias("seq"))
    rel = spark.createDataFrame([], "id string, source string, target string")
    return registry.report_score(registry.overlap_report(ents, rel, spark.createDataFrame([("x",)], "path string"), 1.01))


@query(
    "guard_additions",
    """with a as (select c_custkey as k, case when c_custkey % 3 = 2 then 'relation' else 'entity' end as kind, case when c_custkey % 3 = 1 and c_custkey % 2 = 1 then 'taken' else 'c' || (c_custkey % 400) end as norm from customer),
       r as (select *, case when k % 6 = 0 then 'evidence_required' when kind = 'entity' and norm = 'taken' then 'duplicate_label' when kind = 'relation' and k % 2 = 0 then 'relation_needs_ends' end as reason from a)
       select k as c_custkey, coalesce(reason, case when kind = 'entity' and row_number() over (partition by norm, kind, reason is null order by k) > 1 then 'duplicate_label' end) as rejected from r""",
)
def guard_additions(spark, sf_dir):
    """Customers as additions: entities, some under a label that is taken before or within the batch, and relations, some without an end."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 2, "relation").otherwise("entity")
    label = F.when((k % 3 == 1) & (k % 2 == 1), " Taken").otherwise(F.concat(F.lit(" C"), (k % 400).cast("string")))
    refs = F.when(k % 6 == 0, F.array().cast(_NONE)).otherwise(F.array(F.lit("e")))
    new = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), label.alias("label"), F.lit("a").alias("cluster"), F.when(k % 2 == 0, "").otherwise("s").alias("source"), F.lit("t").alias("target"), _null().alias("type"), refs.alias("source_refs"))
    return registry.guard_additions(new, spark.createDataFrame([("a", "TAKEN ")], "cluster string, label string"), "c_custkey").select("c_custkey", "rejected")


@query(
    "registry_contract",
    """with r as (select c_custkey, case when c_custkey % 11 = 0 then 'bad id' else 'entity:c' || (c_custkey // 2) end as id, case when c_custkey % 13 = 0 then null else c_mktsegment end as label, case when c_custkey % 17 = 0 then 'x' else 'evidence:seed:a' end as ref from customer)
       select rule, count(*) as n from (select 'missing:label' as rule from r where label is null union all select 'pattern:id' from r where id = 'bad id' union all select 'pattern:source_refs' from r where ref = 'x'
       union all select 'duplicate:id' from (select id from r group by id having count(*) > 1)) group by rule""",
)
def registry_contract(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lit("f").alias("file"), F.when(k % 11 == 0, "bad id").otherwise(F.concat(F.lit("entity:c"), F.floor(k / 2).cast("string"))).alias("id"), F.when(k % 13 == 0, _null()).otherwise(F.col("c_mktsegment")).alias("label"), F.array(F.when(k % 17 == 0, "x").otherwise("evidence:seed:a")).alias("source_refs"))
    return registry.registry_violations(rows, "^entity:[a-z0-9]+$", ("id", "label")).groupBy("rule").agg(F.count("*").alias("n"))


@query("index_paths", "select 'd' || doc_id as id, 'p/' || doc_id as path from documents where doc_id not in (select doc_id from labels)")
def index_paths(spark, sf_dir):
    """Documents as an index of paths, labels as the files."""
    path = F.concat(F.lit("p/"), "doc_id")
    out = governance.missing_paths(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), path.alias("path")), table(spark, sf_dir, "labels").select(path.alias("path")))
    return out.select("id", "path")


@query("directories_missing", "select 'd' || n_nationkey as path from nation where n_nationkey not in (select c_nationkey from customer where c_custkey % 40 = 0)")
def directories_missing(spark, sf_dir):
    have = table(spark, sf_dir, "customer").filter("c_custkey % 40 = 0").select(F.concat(F.lit("d"), "c_nationkey").alias("path"))
    return governance.missing_directories(table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("path")), have)


@query("module_upsert", "select p_partkey as id, 'new' as state from part where p_size > 40 union all select p_partkey, 'old' from part where p_size <= 40 and p_size > 5")
def module_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = lambda where, state: p.filter(where).select(F.col("p_partkey").alias("id"), F.lit(state).alias("state"))
    return governance.upsert_modules(row("p_size > 5", "old"), row("p_size > 40", "new"))


@query("threshold_merge", "select user_id as target, event_type as path, arg_max(value, event_id) as value from events group by 1, 2")
def threshold_merge(spark, sf_dir):
    """Later events override earlier ones, key by key."""
    return governance.resolve_thresholds(table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("path"), "value", F.col("event_id").alias("priority")))


_TREE = [(d, True, None) for d in (*materialise.SETUP_DIRS, "harness/trajectory", ".claude/skills")] + [
    ("canonical_root_hub.yaml", False, "\n".join(materialise.SETUP_HUB)), ("agent-context/workflow/index.yaml", False, "workflows: []"), ("docs/index.md", False, "")
]


@query(
    "setup_score",
    """with f as (select (select count(*) from part where p_partkey % 1500 = 1499) = 0 as flows, not exists (select user_id from events group by user_id having bool_or(event_type = 'error') and not bool_or(event_type = 'purchase')) as settled)
       select true as five_layer_directories, true as canonical_hub_valid, flows as workflow_templates_valid, false as memory_harness_skeleton_valid, true as docs_index_present, true as skill_links_valid_or_skipped, settled as no_unresolved_conflicts,
       round(0.2 + 0.2 + WORKFLOWS * flows::int + 0.1 + 0.1 + 0.1 * settled::int, 3)::double as score from f""".replace("WORKFLOWS", str(materialise.SETUP_FLAGS["workflow_templates_valid"])),
)
def setup_score(spark, sf_dir):
    """A repository with a workflow for each part, some of them broken, and a log for each user, some with a request that nobody answered; it has no work memory."""
    good = F.lit("\n".join(materialise.SETUP_WORKFLOW))
    flows = table(spark, sf_dir, "part").select(F.concat(F.lit("agent-context/workflow/p"), "p_partkey", F.lit(".yaml")).alias("path"), F.lit(False).alias("is_dir"), F.when(F.col("p_partkey") % 1500 == 1499, "id: x").otherwise(good).alias("text"))
    said = F.concat_ws(" ", F.when(F.bool_or(F.col("event_type") == "error"), "hitl_request canonical_root_hub_locked_change"), F.when(F.bool_or(F.col("event_type") == "purchase"), "hitl_ack"))
    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(said.alias("text")).select(F.concat(F.lit("harness/trajectory/run-"), "user_id", F.lit(".jsonl")).alias("path"), F.lit(False).alias("is_dir"), "text")
    return materialise.setup_score(spark.createDataFrame(_TREE, "path string, is_dir boolean, text string").unionByName(flows).unionByName(logs))


@query("core_skills", "select count(distinct p_brand) as n, count(distinct p_brand) = 8 as ok from part")
def core_skills(spark, sf_dir):
    return materialise.core_skill_count(table(spark, sf_dir, "part").select(F.col("p_brand").alias("skill")))


@query(
    "contract_check",
    """select 'workflow_id_unique' as contract, p_name as detail from part group by p_name having count(*) > 1 union all select 'workflow_path', 'p' || s_suppkey from supplier where s_suppkey % 9 = 0
       union all select 'canonical_root_hub_locked', 'hub' union all select 'pack_config_core_count', count(distinct r_name)::varchar from region union all select 'pack_config_version', 'v0'""",
)
def contract_check(spark, sf_dir):
    """Parts as workflows by name, suppliers as indexed paths, regions as the skills of a pack."""
    t = lambda n: table(spark, sf_dir, n)
    flows = t("part").select(F.col("p_name").alias("id"), F.col("p_partkey").cast("string").alias("file"))
    path = F.concat(F.lit("p"), "s_suppkey").alias("path")
    return materialise.contract_check(flows, t("supplier").select(path), t("supplier").filter("s_suppkey % 9 <> 0").select(path), spark.createDataFrame([("open",)], "text string"), t("region").select(F.col("r_name").alias("skill")), "v0", "strict-soft", "v1")


@query(
    "gate_requests",
    """with m as (select user_id, arg_min(value, event_id) as v, min(event_id) as f from events where event_type = 'error' group by 1)
       select user_id as run_id, axis, reason from (select user_id, 'oracle' as axis, 'oracle_below_threshold' as reason from m where v / 20 < 0.85 union all select user_id, 'trajectory', 'trajectory_incomplete' from m where f % 7 = 0)""",
)
def gate_requests(spark, sf_dir):
    """One request to a person for each axis that the first error of a user breaks."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "value", F.lit("governance_measurement").alias("event_type"))
    first = governance.first_measurement(e)
    zero = F.lit(0)
    m = first.select("run_id", F.lit(0.0).alias("non_determinism"), (F.col("seq") % 7 != 0).alias("trajectory_complete"), (F.col("value") / 20).alias("oracle_score"), F.lit("fallback").alias("mode"), zero.alias("tokens"), zero.alias("seconds"), zero.alias("power_wh"), F.lit(False).alias("required"), zero.alias("requested"), zero.alias("acked"))
    return governance.gate(m).select("run_id", F.explode(F.arrays_zip("violated", "reasons")).alias("x")).select("run_id", F.col("x.violated").alias("axis"), F.col("x.reasons").alias("reason"))


@query(
    "intervention_rate",
    """with r as (select strftime(ts, '%Y-%m') as period, user_id, bool_or(event_type = 'signup') as asked, sum(event_id % 3)::bigint as drift from events group by 1, 2)
       select period, count(*) as runs, count(*) filter (where asked) as asked, round_even(count(*) filter (where asked) / count(*), 3) as rate, sum(drift)::bigint as drift from r group by period""",
)
def intervention_rate(spark, sf_dir):
    """Users as runs, by month; a signup asks a person."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "hitl_request").otherwise(F.col("event_type"))
    rows = e.select(F.col("user_id").alias("run_id"), kind.alias("event_type"), (F.col("event_id") % 3).alias("drift"), "ts")
    return materialise.intervention(rows, F.date_format("ts", "yyyy-MM"))


# --- roles, provenance, compiling ---------------------------------------------------------------------


def _event_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("x"), F.col("event_type").alias("p"), (F.col("event_id") % 50).cast("string").alias("y"))


_ROLES = [("view", "stable", ["Looks at"]), ("click", "draft", ["view"]), ("signup", "accepted", ["Sign Up", "click"])]


@query(
    "role_gate",
    """select 'undeclared' as rule, event_type as subject, count(*)::varchar as detail from events where event_type not in ('view', 'click', 'signup') group by event_type
       union all select 'draft_in_use', 'click', count(*)::varchar from events where event_type = 'click' union all select 'alias_collision', 'click', 'view' union all select 'alias_collision', 'signup', 'click'""",
)
def role_gate(spark, sf_dir):
    """Event types as properties; three roles, one a draft, two with an alias that is another's name."""
    return materialise.role_gate(_event_facts(spark, sf_dir), spark.createDataFrame(_ROLES, "name string, status string, aliases array<string>"))


@query(
    "role_characteristics",
    """with f as (select distinct user_id, event_type as p, event_id % 50 as y from events)
       select rule, count(*) as n from (select 'functional' as rule from f where p = 'view' group by user_id having count(distinct y) > 1 union all select 'inverse_functional' from f where p = 'click' group by y having count(distinct user_id) > 1
       union all select 'irreflexive' from f where p = 'signup' and user_id = y union all select 'asymmetric' from f a where p = 'purchase' and exists (select 1 from f b where b.p = 'purchase' and b.user_id = a.y and b.y = a.user_id)) group by rule""",
)
def role_characteristics(spark, sf_dir):
    facts = _event_facts(spark, sf_dir).distinct()
    return reasoning.characteristic_violations(facts, ["view"], ["click"], ["purchase"], ["signup"]).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "axiom_gate",
    """select 'a' || n_nationkey as role, 'undeclared' as rule, 'n' || n_regionkey * 9 as ref from nation where n_regionkey * 9 >= 25 union all select 'a' || n_nationkey, 'undeclared', 'a' || n_nationkey from nation where n_nationkey % 5 = 0
       union all select 'a' || n_nationkey, 'chain_too_short', 'x' from nation where n_nationkey % 7 = 1""",
)
def axiom_gate(spark, sf_dir):
    """Nations as axioms over roles, some not declared, some with a chain of one."""
    n = table(spark, sf_dir, "nation")
    role, k = F.concat(F.lit("a"), "n_nationkey"), F.col("n_nationkey")
    axioms = n.select(role.alias("role"), F.array(F.concat(F.lit("n"), (F.col("n_regionkey") * 9).cast("string"))).alias("refs"), F.when(k % 7 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("chain"))
    roles = n.filter("n_nationkey % 5 <> 0").select(role.alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("name")))
    return reasoning.axiom_violations(axioms, roles)


@query("individual_facts", "select distinct 'u' || user_id as x, event_type as p, 'u' || event_id % 50 as y from events where event_type in ('view', 'click') and user_id % 2 = 0 and (event_id % 50) % 2 = 0")
def individual_facts(spark, sf_dir):
    """Facts between even users over two declared properties."""
    e = table(spark, sf_dir, "events")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    triples = e.select(u(F.col("user_id")).alias("s"), F.col("event_type").alias("p"), u(F.col("event_id") % 50).alias("o"))
    named = e.select(F.col("user_id").alias("k")).unionByName(e.select((F.col("event_id") % 50).alias("k"))).filter("k % 2 = 0").select(u(F.col("k")).alias("iri"))
    return reasoning.individual_facts(triples, named, spark.createDataFrame([("view",), ("click",)], "iri string")).distinct()


@query("reason_domain_range", "select distinct 'c' || o_custkey as x, 'Buyer' as c from orders union select 'o' || o_orderkey, 'Order' from orders union select 'o' || o_orderkey, 'Thing' from orders")
def reason_domain_range(spark, sf_dir):
    """Who placed is a buyer, what was placed an order, and every order a thing."""
    props = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("x"), F.lit("placed").alias("p"), F.concat(F.lit("o"), "o_orderkey").alias("y"))
    return reasoning.close_types(spark.createDataFrame([], "x string, c string"), props, Rules(domain=[("placed", "Buyer")], range=[("placed", "Order")], subclass=[("Order", "Thing")]))


@query(
    "provenance_sources",
    """select 'd' || doc_id as id, case when doc_id % 3 = 0 then 'r' || doc_id || ',s' when doc_id % 3 = 1 then coalesce(source, 'web') else 'web' end as sources from documents""",
)
def provenance_sources(spark, sf_dir):
    """References, else the source file, else the source."""
    k = F.col("doc_id")
    refs = F.when(k % 3 == 0, F.array(F.concat(F.lit("r"), k.cast("string")), F.lit("s")))
    ents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), _null().alias("owl_class"), refs.alias("source_refs"), F.when(k % 3 == 1, F.col("source")).otherwise("").alias("source_file"), F.lit("web").alias("source"))
    return provenance.sources_of(ents).select("id", F.array_join("sources", ",").alias("sources"))


def _joined(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels").select("doc_id").distinct()
    i = F.concat(F.lit(_EX + "d"), "doc_id")
    ents = l.select(i.alias("id"), _null().alias("owl_class"), F.array(F.concat(F.lit("src "), "doc_id")).alias("source_refs"), _null().alias("source_file"), _null().alias("source"))
    return provenance.two_step_join(d.select(i.alias("iri"), i.alias("identifier")), ents, d.filter("doc_id % 5 = 0").select(i.alias("iri")))


_PROV = "with d as (select distinct doc_id, doc_id in (select doc_id from labels) as has from documents)"


@query("provenance_coverage", f"{_PROV} select count(*) as classes, count(*) filter (where has) as joined, count(*) filter (where not has and doc_id % 5 = 0) as exempt, count(*) filter (where not has and doc_id % 5 <> 0) as ungrounded from d")
def provenance_coverage(spark, sf_dir):
    return provenance.coverage(_joined(spark, sf_dir))


@query(
    "provenance_projection",
    f"""{_PROV} select '{_EX}src_' || doc_id as s, '{comp.RDF}type' as p, '{comp.PROV}Entity' as o from d where has union all select '{_EX}d' || doc_id, '{comp.PROV}hadPrimarySource', '{_EX}src_' || doc_id from d where has
        union all select '{_EX}d' || doc_id, '{_EX}structural', 'true' from d where not has and doc_id % 5 = 0""",
)
def provenance_projection(spark, sf_dir):
    return provenance.projection(_joined(spark, sf_dir), _EX).select("s", "p", "o")


@query("shape_ungrounded", f"{_PROV} select '{_EX}d' || doc_id as focus from d where not has and doc_id % 5 <> 0")
def shape_ungrounded(spark, sf_dir):
    """The gate over the projection above: classes with neither a source nor a mark."""
    d = table(spark, sf_dir, "documents").select("doc_id").distinct()
    classes = d.select(F.concat(F.lit(_EX + "d"), "doc_id").alias("s"), F.lit(comp.RDF + "type").alias("p"), F.lit(comp.OWL + "Class").alias("o"), F.lit("iri").alias("o_kind"), _null().alias("o_lang"), _null().alias("o_dt"))
    return provenance.ungrounded(classes.unionByName(provenance.projection(_joined(spark, sf_dir), _EX)), _EX, _EX)


@query(
    "carrier_rewrite",
    f"""with n as (select '{_EX}r' || n_nationkey as s, n_nationkey % 4 as k, n_regionkey from nation)
        select s, case k when 0 then '{comp.RDF}type' when 1 then '{comp.OWL}inverseOf' when 2 then '{comp.OWL}propertyChainAxiom' else '{comp.RDFS}subPropertyOf' end as p,
               case k when 0 then '{comp.OWL}TransitiveProperty' when 1 then '{_EX}q' || n_regionkey when 2 then '{_EX}a {_EX}b' else 'http://other.org/p' end as o from n""",
)
def carrier_rewrite(spark, sf_dir):
    """Nations as roles with one annotation each; rewriting twice is rewriting once."""
    k = F.col("n_nationkey") % 4
    key = F.when(k == 0, "owl_characteristic").when(k == 1, "inverse_of").when(k == 2, "property_chain").otherwise("subproperty_of")
    value = F.when(k == 0, "transitive").when(k == 1, F.concat(F.lit("q"), "n_regionkey")).when(k == 2, "a, b").otherwise("http://other.org/p")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit(_EX + "r"), "n_nationkey").alias("s"), F.concat(F.lit(_EX), key).alias("p"), value.alias("o"), F.lit("literal").alias("o_kind"), _null().alias("o_lang"), _null().alias("o_dt"))
    return comp.rewrite_carriers(comp.rewrite_carriers(rows, _EX)[0], _EX)[0].select("s", "p", "o")


@query(
    "instance_triples",
    f"""select '{_EX}n' || n_nationkey as s, '{comp.RDF}type' as p, '{comp.OWL}NamedIndividual' as o, null as dt from nation union all select '{_EX}n' || n_nationkey, '{comp.RDF}type', '{_EX}Nation', null from nation
        union all select '{_EX}n' || n_nationkey, '{_EX}region', '{_EX}r' || n_regionkey, null from nation union all select '{_EX}n' || n_nationkey, '{_EX}size', (n_nationkey * 2)::varchar, '{comp.XSD}integer' from nation
        union all select '{_EX}n' || n_nationkey, '{_EX}says', n_name || ' says', null from nation""",
)
def instance_triples(spark, sf_dir):
    slots = F.create_map(F.lit("region"), F.array(F.concat(F.lit("r"), "n_regionkey")), F.lit("size"), F.array((F.col("n_nationkey") * 2).cast("string")), F.lit("says"), F.array(F.concat("n_name", F.lit(" says"))))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("instance_of"), slots.alias("slots"))
    return comp.compile_instances(rows, _EX).select("s", "p", "o", F.col("o_dt").alias("dt"))


_DEFINITION = {"default_prefix": "ex", "prefixes": {"ex": _EX}, "classes": {"Place": {}, "Nation": {"is_a": "Place"}, "Home": {"classification_rules": [{"is_a": "Nation", "slot_conditions": {"region": {"range": "Region"}}}]}}}
_ROLE_FILE = {"slots": {"region": {}, "near": {"symmetric": True}, "within": {"transitive": True, "annotations": {"subproperty_of": "near"}}}}


def _sources(spark, sf_dir, definition):
    """Nations and regions as instances; a nation lies in its region, and is within the next nation of its region."""
    import json

    n = table(spark, sf_dir, "nation")
    head = F.lit(json.dumps({"default_prefix": "ex", "prefixes": {"ex": _EX}}))
    following = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_regionkey").alias("r2"))
    within = F.when(F.col("r2") == F.col("n_regionkey"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")))
    slots = F.create_map(F.lit("region"), F.array(F.concat(F.lit("r"), "n_regionkey")), F.lit("within"), F.filter(F.array(within), lambda x: x.isNotNull()))
    nations = n.join(following, "n_nationkey", "left").select(F.lit("d").alias("stem"), head.alias("head"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("instance_of"), slots.alias("slots"))
    regions = table(spark, sf_dir, "region").select(F.lit("d").alias("stem"), head.alias("head"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Region").alias("instance_of"), F.create_map().cast("map<string,array<string>>").alias("slots"))
    return materialise.compiled(spark, {"d": definition}, {"d": _ROLE_FILE}, nations.unionByName(regions))


def _ontology(spark, sf_dir, definition):
    return materialise.reasoned(*_sources(spark, sf_dir, definition))


_RUNS = """with recursive e as (select a.n_nationkey as s, b.n_nationkey as t from nation a join nation b on b.n_nationkey = a.n_nationkey + 1 and a.n_regionkey = b.n_regionkey),
    w(s, t) as (select s, t from e union select w.s, e.t from w join e on w.t = e.s)"""


@query(
    "materialise",
    f"""{_RUNS} select 'n' || n_nationkey as x, 'a Place' as fact from nation union all select 'n' || n_nationkey, 'a Home' from nation
        union all select 'n' || s, 'within n' || t from w where t <> s + 1 union all select 'n' || s, 'near n' || t from (select s, t from w union select t, s from w)""",
)
def materialised(spark, sf_dir):
    """Classes, roles and instances compiled and reasoned over in one go: all that is gained."""
    m = _ontology(spark, sf_dir, _DEFINITION)
    facts = m.gained_types.select("x", F.concat(F.lit("a "), S.iri_local(F.col("c"))).alias("fact")).unionByName(m.gained_props.select("x", F.concat_ws(" ", S.iri_local(F.col("p")), S.iri_local(F.col("y"))).alias("fact")))
    return facts.select(S.iri_local(F.col("x")).alias("x"), "fact")


@query("what_if", "select 'n' || n_nationkey as x, 'removed' as change, 'a Home' as fact from nation union all select 'n' || n_nationkey, 'added', 'a Thing' from nation")
def what_if(spark, sf_dir):
    """The ontology above against one without its rule and with a class above."""
    then = {**_DEFINITION, "classes": {"Thing": {}, "Place": {"is_a": "Thing"}, "Nation": {"is_a": "Place"}, "Home": {}}}
    out = materialise.what_if(_sources(spark, sf_dir, _DEFINITION), _sources(spark, sf_dir, then))
    return out.select(S.iri_local(F.col("x")).alias("x"), "change", F.concat(F.lit("a "), S.iri_local(F.col("fact"))).alias("fact"))


@query(
    "explain",
    f"""{_RUNS},
    p as (select s as x, 'near' as p, 'n' || t as y from (select s, t from w union select t, s from w) union all select s, 'within', 'n' || t from w where t <> s + 1),
    per as (select x, p, string_agg(y, ',' order by y) as ys from p group by 1, 2), props as (select x, string_agg(p || '=' || ys, ';' order by p) as inferred_properties from per group by 1),
    own as (select 'n' || n_nationkey as id, n_name as label from nation where n_nationkey % 2 = 0 union all select 'c' || c_custkey, c_name from customer),
    got as (select 'n' || n_nationkey as id, 'Home,Place' as inferred_types, inferred_properties from nation left join props on x = n_nationkey)
    select coalesce(o.id, g.id) as id, label, inferred_types, inferred_properties from own o full join got g on o.id = g.id""",
)
def explain(spark, sf_dir):
    """Records of even nations and of all customers beside what is inferred of all nations: the records themselves."""
    m = _ontology(spark, sf_dir, _DEFINITION)
    own = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit(_EX + "n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    own = own.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit(_EX + "c"), "c_custkey").alias("id"), F.col("c_name").alias("label")))
    out = materialise.explain(own, m.records)
    gained = F.from_json("inferred", "inferred_types array<string>, inferred_properties map<string,array<string>>")
    entries = F.transform(F.map_entries(gained["inferred_properties"]), lambda e: F.concat(S.iri_local(e["key"]), F.lit("="), F.array_join(F.array_sort(F.transform(e["value"], S.iri_local)), ",")))
    props = F.array_join(F.array_sort(entries), ";")
    return out.select(S.iri_local(F.col("id")).alias("id"), F.get_json_object("original", "$.label").alias("label"), F.array_join(F.array_sort(F.transform(gained["inferred_types"], S.iri_local)), ",").alias("inferred_types"), F.when(props != "", props).alias("inferred_properties"))


@query("shape_inference", "select on_, case when on_ then count(*) else 0 end as n from nation, (select unnest([true, false]) as on_) group by on_")
def shape_inference(spark, sf_dir):
    """A shape on places: without inference nothing is stated to be one, with it every nation lacks a name."""
    m = _ontology(spark, sf_dir, _DEFINITION)
    count = lambda on: provenance.check_shape(materialise.shape_triples(m, on), _EX + "Place", [{"path": _EX + "name", "min": 1}]).agg(F.count("*").alias("n")).select(F.lit(on).alias("on_"), "n")
    return count(True).unionByName(count(False))


@query("role_states", "select 'r' || n_nationkey as name, case when n_nationkey % 4 = 0 then 'axiomatised' else 'declared' end as state from nation")
def role_states(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_nationkey").alias("name"))
    return materialise.list_roles(n.select("name"), n.filter("n_nationkey % 4 = 0").select(F.col("name").alias("role")))


@query(
    "role_declarations",
    "select name, rejected, count(*) as n from (select p_name as name, case when p_name < 'm' then 'duplicate_role' when row_number() over (partition by p_name order by p_partkey) > 1 then 'duplicate_role' end as rejected from part) group by 1, 2",
)
def role_declarations(spark, sf_dir):
    """Part names as new roles; those before m are there already."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.array(F.lit("e")).alias("source_refs"))
    return materialise.declare_roles(p.filter("name < 'm'").select("name"), p).groupBy("name", "rejected").agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    """Run events as JSON-lines files; the folder."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "step_started").when(F.col("event_type") == "purchase", "step_finished").when(F.col("event_type") == "click", "cost_increment").otherwise("oracle_evaluation")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), kind.alias("event_type"), (F.col("event_id") % 20).cast("string").alias("step_id"), (F.col("event_id") % 9).alias("tokens_delta"), F.lit(0.5).alias("seconds_delta"), F.lit(0.0).alias("power_wh_delta"))
    path = shared_path(spark, "events")
    rows.repartition(3).write.json(path)
    return path


def _drained(spark, sf_dir, build, mode):
    """A stream over the log, run until all of it is read; the rows of its sink."""
    path, out = _log(spark, sf_dir), shared_path(spark, "stream")
    events = spark.readStream.schema(runs.model.EVENTS).option("maxFilesPerTrigger", 1).json(path).withColumn("at", F.try_to_timestamp("ts"))

    def each(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    build(events).writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_cost", "select user_id::varchar as run_id, sum(event_id % 9)::bigint as tokens, count(*) * 0.5::double as seconds from events where event_type = 'click' group by 1")
def stream_cost(spark, sf_dir):
    """Costs of each run, as the stream last told them."""
    told = _drained(spark, sf_dir, runs.cost_stream, "update")
    return told.groupBy("run_id").agg(F.max_by(F.struct("tokens", "seconds"), "epoch").alias("c")).select("run_id", "c.*")


@query(
    "stream_steps",
    "select user_id::varchar as run_id, (event_id % 20)::varchar as step_id, count(*) filter (where event_type = 'view') as starts, count(*) filter (where event_type = 'purchase') as ends from events where event_type in ('view', 'purchase') group by 1, 2",
)
def stream_steps(spark, sf_dir):
    """Starts and ends of each step, as the stateful stream last told them."""
    told = _drained(spark, sf_dir, runs.step_stream, "update")
    return told.groupBy("run_id", "step_id").agg(F.max_by(F.struct("starts", "ends"), "epoch").alias("c")).select("run_id", "step_id", "c.*")


@query("stream_dedup", "select distinct user_id::varchar as run_id from events")
def stream_dedup(spark, sf_dir):
    """The first event of each run."""
    return _drained(spark, sf_dir, lambda e: runs.dedup_stream(e, "run_id"), "append").select("run_id")


@query("stream_append", "select user_id::varchar as run_id, count(*) as n from events group by 1")
def stream_append(spark, sf_dir):
    """Events that a stream appends to a log, read from the log."""
    out = shared_path(spark, "log")
    events = spark.readStream.schema(runs.model.EVENTS).json(_log(spark, sf_dir))
    runs.append_events(events, out, shared_path(spark, "offsets")).awaitTermination()
    return files.read_jsonl(spark, out, runs.model.EVENTS, "FAILFAST").groupBy("run_id").agg(F.count("*").alias("n"))


@query("stream_rules", "select 'opened' as rule_id, count(*) as n from events where event_type = 'view' union all select 'spent', count(*) from events where event_type = 'click' and event_id % 9 > 4")
def stream_rules(spark, sf_dir):
    """Rules that fire on each micro-batch, and their log."""
    log = shared_path(spark, "fired")
    rules = [("opened", "event_type = 'step_started'", "notify"), ("spent", "event_type = 'cost_increment' and tokens_delta > 4", "log")]
    runs.run_rules(spark.readStream.schema(runs.model.EVENTS).json(_log(spark, sf_dir)), rules, "events", log, shared_path(spark, "offsets")).awaitTermination()
    return files.read_jsonl(spark, log, "rule_id string").groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "silence_rules",
    """
    with e as (select 'view' as rule_id, user_id, ts from events where event_type = 'view' union all select 'any', user_id, ts from events),
    n as (select *, lead(ts) over (partition by rule_id, user_id order by ts) as next, (select max(ts) from events) - interval 1 hour as mark from e),
    g as (select *, case when rule_id = 'view' then interval 36 hours else interval 12 hours end as gap from n)
    select rule_id, user_id::varchar as who, epoch_us(ts) as last_us, epoch_us(ts + gap) as fired_us from g where case when next is null then ts + gap <= mark else next > ts + gap end""",
)
def silence_rules(spark, sf_dir):
    """Users who are silent too long, by event-time timers; the stream is stopped halfway and goes on from its checkpoint."""
    e, path, out = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("who"), "event_type", F.col("ts").alias("at")), shared_path(spark, "events"), shared_path(spark, "fired")
    middle = e.agg(F.percentile_approx("at", 0.5).alias("m")).first().m
    rules = [schedule.Silence("view", "event_type = 'view'", 36 * 3600), schedule.Silence("any", "true", 12 * 3600)]
    offsets = shared_path(spark, "offsets")
    for part in (e.filter(F.col("at") <= middle), e.filter(F.col("at") > middle)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(e.schema).parquet(path)
        schedule.run_silences(stream, rules, "who", "at", out, offsets, late="1 hour").awaitTermination()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return files.read_jsonl(spark, out, "rule_id string, key string, last_at string, fired_at string").select("rule_id", F.col("key").alias("who"), us("last_at").alias("last_us"), us("fired_at").alias("fired_us"))


@query("log_of_batches", "select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 2")
def log_of_batches(spark, sf_dir):
    """A log of appended batches: one of them replayed, one that fails midway and leaves nothing."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), shared_path(spark, "log")
    for k in (0, 1, 1):
        notes.append_jsonl(o.filter(F.col("o_orderkey") % 3 == k), path, f"part-{k}")
    try:
        notes.append_jsonl(o.filter("o_orderkey % 3 = 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 50, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("o_orderstatus"))), path)
    except PySparkException:
        pass
    return files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string", "FAILFAST")
