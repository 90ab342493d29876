"""Compiling class, role and instance definitions to triples, and writing triples as Turtle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.model import CHARACTERISTICS, TRIPLES
from kbspark.operators.reasoning import Rules

RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
OWL, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
SKOS, PROV = "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/ns/prov#"
MOST_AXIOMS = 100_000
_SHORT = {c.removesuffix("Property").lower(): c for c in CHARACTERISTICS} | {"inverse_functional": "InverseFunctionalProperty"}


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(s, p, o, k, None, d) for s, p, o, k, d in rows], TRIPLES)


def compile_classes(spark: SparkSession, definition: dict, base: str) -> tuple[DataFrame, Rules]:
    """Triples of a definition's classes and slots, and its rules (sufficient conditions)."""
    rows, rules = [], Rules()
    for name, c in (definition.get("classes") or {}).items():
        c = c or {}
        rows.append((base + name, RDF + "type", OWL + "Class", "iri", None))
        if c.get("is_a"):
            rows.append((base + name, RDFS + "subClassOf", base + c["is_a"], "iri", None))
            rules.subclass.append((base + name, base + c["is_a"]))
        if c.get("description"):
            rows.append((base + name, SKOS + "definition", str(c["description"]), "literal", None))
        rows += [(base + name, base + k, _plain(v), "literal", None) for k, v in (c.get("annotations") or {}).items()]
        for rule in c.get("classification_rules") or []:
            wanted = tuple((base + s, base + cond["range"]) for s, cond in (rule.get("slot_conditions") or {}).items())
            rules.conditions.append((base + name, base + rule["is_a"] if rule.get("is_a") else None, wanted))
    for name, s in (definition.get("slots") or {}).items():
        rows += _role_rows(base, name, s or {})
    return _frame(spark, rows), rules


def _plain(v) -> str:
    return str(v["value"] if isinstance(v, dict) and "value" in v else v)


def _role_rows(base: str, name: str, s: dict) -> list[tuple]:
    iri = base + name
    rows = [(iri, RDF + "type", OWL + "ObjectProperty", "iri", None)]
    rows += [(iri, RDFS + k, base + s[k], "iri", None) for k in ("domain", "range") if s.get(k)]
    rows += [(iri, SKOS + "altLabel", str(a), "literal", None) for a in s.get("aliases") or []]
    if s.get("description"):
        rows.append((iri, SKOS + "definition", str(s["description"]), "literal", None))
    carriers = {k: _plain(v) for k, v in (s.get("annotations") or {}).items()}
    # Native keys say the same as the carriers.
    carriers |= {"inverse_of": s["inverse"]} if s.get("inverse") else {}
    carriers |= {"owl_characteristic": k.capitalize() + "Property" for k in ("transitive", "symmetric") if s.get(k) and "owl_characteristic" not in carriers}
    return rows + [(iri, base + k, v, "literal", None) for k, v in carriers.items()]


def compile_roles(spark: SparkSession, roles: dict, base: str) -> DataFrame:
    """Triples of a role file's slots, carriers rewritten."""
    return rewrite_carriers(_frame(spark, [r for name, s in (roles.get("slots") or {}).items() for r in _role_rows(base, name, s or {})]), base)[0]


def rewrite_carriers(triples: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(triples, warnings): annotation carriers become formal triples; running it again changes nothing.

    A property chain becomes one row ``owl:propertyChainAxiom`` whose object lists the roles in order,
    separated by spaces. Unknown characteristics stay and are warned about.
    """
    k = S.iri_local(F.col("p"))
    mine = triples.withColumn("k", k)
    iri_of = lambda c: F.when(c.contains("://"), c).otherwise(F.concat(F.lit(base), c))
    value = S.strip(F.col("o"))
    long = F.create_map(*[F.lit(x) for pair in _SHORT.items() for x in pair])
    full = F.coalesce(F.try_element_at(long, F.lower(value)), value)
    known = full.isin(*CHARACTERISTICS)
    lang = F.regexp_extract("k", r"^label_([a-z]{2,3})$", 1)
    is_char, is_label = F.col("k") == "owl_characteristic", lang != ""
    one = {"subproperty_of": RDFS + "subPropertyOf", "inverse_of": OWL + "inverseOf"}
    chain = F.array_join(F.transform(F.filter(F.split(value, r"\s*,\s*"), lambda x: x != ""), iri_of), " ")
    carried = (is_char & known) | is_label | F.col("k").isin(*one, "property_chain")
    p = F.when(is_char, RDF + "type").when(is_label, RDFS + "label").when(F.col("k") == "subproperty_of", one["subproperty_of"]).when(F.col("k") == "inverse_of", one["inverse_of"]).when(F.col("k") == "property_chain", OWL + "propertyChainAxiom").otherwise(F.col("p"))
    o = F.when(is_char, F.concat(F.lit(OWL), full)).when(is_label, F.col("o")).when(F.col("k").isin(*one), iri_of(value)).when(F.col("k") == "property_chain", chain).otherwise(F.col("o"))
    kind = F.when(is_label, "literal").when(F.col("k") == "property_chain", "list").otherwise("iri")
    out = mine.select("s", F.when(carried, p).otherwise(F.col("p")).alias("p"), F.when(carried, o).otherwise(F.col("o")).alias("o"), F.when(carried, kind).otherwise(F.col("o_kind")).alias("o_kind"), F.when(carried & is_label, lang).otherwise(F.col("o_lang")).alias("o_lang"), "o_dt")
    warnings = mine.filter(is_char & ~known).select("s", F.concat(F.lit("unknown characteristic: "), "o").alias("warning"))
    return out.distinct(), warnings


def rules_of(triples: DataFrame) -> Rules:
    """The axioms that triples state, for the reasoner. They come from ontology files; more than MOST_AXIOMS raise."""
    wanted = {RDFS + "subClassOf", RDFS + "subPropertyOf", OWL + "inverseOf", OWL + "propertyChainAxiom", RDFS + "domain", RDFS + "range"}
    marks = {OWL + "SymmetricProperty": "symmetric", OWL + "TransitiveProperty": "transitive"}
    rules = Rules()
    rows = triples.filter(F.col("p").isin(*wanted) | ((F.col("p") == RDF + "type") & F.col("o").isin(*marks))).select("s", "p", "o", "o_kind").distinct().orderBy("s", "p", "o").limit(MOST_AXIOMS + 1).collect()
    if len(rows) > MOST_AXIOMS:
        raise ValueError(f"more than {MOST_AXIOMS} axioms: these are facts, not an ontology")
    for r in rows:
        if r.o_kind == "bnode":
            continue
        if r.p == RDF + "type":
            getattr(rules, marks[r.o]).append(r.s)
        elif r.p == OWL + "propertyChainAxiom":
            rules.chains.append((tuple(r.o.split(" ")), r.s))
        else:
            to = {RDFS + "subClassOf": rules.subclass, RDFS + "subPropertyOf": rules.subproperty, OWL + "inverseOf": rules.inverse, RDFS + "domain": rules.domain, RDFS + "range": rules.range}[r.p]
            to.append((r.s, r.o))
    return rules


def compile_instances(instances: DataFrame, base: str | None = None) -> DataFrame:
    """Triples of instances (id, instance_of, slots map<string,array<string>>, values as JSON text); without ``base`` each row's ``base`` is its own."""
    instances = instances if base is None else instances.withColumn("base", F.lit(base))
    i = F.concat("base", "id")
    row = lambda df, p, o, kind, dt: df.select(i.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), dt.alias("o_dt"))
    none, iri = F.lit(None).cast("string"), F.lit("iri")
    out = row(instances, F.lit(RDF + "type"), F.lit(OWL + "NamedIndividual"), iri, none).unionByName(row(instances.filter("instance_of is not null"), F.lit(RDF + "type"), F.concat("base", "instance_of"), iri, none))
    values = instances.select("id", "base", F.explode("slots").alias("slot", "vs")).select("id", "base", "slot", F.explode("vs").alias("v"))
    kind = S.literal_kind(F.col("v"))
    dt = F.when(F.col("v").rlike("^(true|false)$"), XSD + "boolean").when(F.col("v").rlike("^-?[0-9]+$"), XSD + "integer").when(F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), XSD + "double")
    return out.unionByName(row(values, F.concat("base", "slot"), F.when(kind == "iri", F.concat("base", "v")).otherwise(F.col("v")), kind, dt))


def turtle_lines(triples: DataFrame) -> DataFrame:
    """(line) one N-Triples line for each triple, with lists as collections."""
    esc = F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    iri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    lit = F.concat(F.lit('"'), esc, F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^<"), "o_dt", F.lit(">")), F.lit("")))
    items = F.concat(F.lit("( "), F.array_join(F.transform(F.split("o", " "), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), " "), F.lit(" )"))
    obj = F.when(F.col("o_kind") == "literal", lit).when(F.col("o_kind") == "list", items).otherwise(iri(F.col("o")))
    return triples.select(F.concat(iri(F.col("s")), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("line"))


def with_lists(triples: DataFrame) -> DataFrame:
    """RDF lists read from files as ``list`` objects in order; each list is short and belongs to one subject."""
    first, rest = triples.filter(F.col("p") == RDF + "first"), triples.filter(F.col("p") == RDF + "rest")
    cells = first.select("s", F.col("o").alias("item")).join(rest.select("s", F.col("o").alias("next")), "s")
    plain = triples.filter(~F.col("p").isin(RDF + "first", RDF + "rest"))
    heads = plain.filter(F.col("o_kind") == "bnode").join(cells.select(F.col("s").alias("o")), "o", "left_semi")
    walk = heads.select("s", "p", F.col("o").alias("at"), F.array().cast("array<string>").alias("items"))
    done = None
    while True:
        walk = walk.join(cells.withColumnRenamed("s", "at"), "at").select("s", "p", F.concat("items", F.array("item")).alias("items"), F.col("next").alias("at"))
        end = walk.filter(F.col("at") == RDF + "nil").select("s", "p", F.array_join("items", " ").alias("o"))
        done = end if done is None else done.unionByName(end)
        walk = walk.filter(F.col("at") != RDF + "nil")
        if walk.isEmpty():
            break
    none = F.lit(None).cast("string")
    lists = done.select("s", "p", "o", F.lit("list").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"))
    return plain.join(heads.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select("s", "p", "o", "o_kind", "o_lang", "o_dt").unionByName(lists)


def create_table_ddl(definition: dict, cls: str) -> str:
    """``CREATE TABLE`` statement of a class's slots."""
    kinds = {"string": "STRING", "integer": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP"}
    slots = (definition["classes"][cls] or {}).get("slots") or []
    cols = ["id STRING NOT NULL"]
    for s in slots:
        d = (definition.get("slots") or {}).get(s) or {}
        kind = kinds.get(d.get("range", "string"), "STRING")
        cols.append(f"{s} " + (f"ARRAY<{kind}>" if d.get("multivalued") else kind))
    return f"CREATE TABLE {cls} ({', '.join(cols)}) USING parquet"
