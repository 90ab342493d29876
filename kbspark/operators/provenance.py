"""Provenance: joining classes to their evidence, and gates over it; a subset of shape constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.operators.reasoning import once


def sources_of(entities: DataFrame) -> DataFrame:
    """(id, owl_class, sources): ``source_refs``, else ``source_file``, else ``source``."""
    refs = F.col("source_refs")
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c))
    sources = F.coalesce(F.when(F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0, refs), one(F.col("source_file")), one(F.col("source")))
    return entities.select("id", "owl_class", sources.alias("sources"))


def two_step_join(classes: DataFrame, entities: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(iri, status, sources): classes (iri, identifier) by identifier, else by class IRI; joined, exempt or ungrounded."""
    src = sources_of(entities).filter("sources is not null").select("id", "owl_class", F.explode("sources").alias("s"))
    by_id = src.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("a"))
    by_iri = src.filter("owl_class is not null").groupBy("owl_class").agg(F.array_sort(F.collect_set("s")).alias("b"))
    out = classes.join(by_id, F.col("identifier") == F.col("id"), "left").join(by_iri, F.col("iri") == F.col("owl_class"), "left")
    found = F.coalesce("a", "b")
    free = (exempt.select(F.col("iri").alias("_x")).distinct() if exempt is not None else classes.select(F.col("iri").alias("_x")).filter("false"))
    out = out.join(free, F.col("iri") == F.col("_x"), "left")
    status = F.when(found.isNotNull(), "joined").when(F.col("_x").isNotNull(), "exempt").otherwise("ungrounded")
    return out.select("iri", status.alias("status"), F.coalesce(found, F.array().cast("array<string>")).alias("sources"))


def coverage(joined: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return joined.agg(F.count("*").alias("classes"), n("joined"), n("exempt"), n("ungrounded"))


def projection(joined: DataFrame, base: str) -> DataFrame:
    """Triples that link each grounded class to its sources as provenance entities, and mark exempt ones."""
    from kbspark.operators.compile import PROV, RDF

    none = F.lit(None).cast("string")
    row = lambda df, s, p, o, kind: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"))
    links = joined.select("iri", F.explode("sources").alias("src"))
    src = S.source_iri(base, F.col("src"))
    out = row(links, src, RDF + "type", F.lit(PROV + "Entity"), "iri").unionByName(row(links, F.col("iri"), PROV + "hadPrimarySource", src, "iri"))
    return out.unionByName(row(joined.filter("status = 'exempt'"), F.col("iri"), base + "structural", F.lit("true"), "literal")).distinct()


def ungrounded(triples: DataFrame, namespace: str, base: str) -> DataFrame:
    """(focus): classes of the namespace without a source IRI that are not marked structural."""
    from kbspark.operators.compile import OWL, PROV, RDF

    classes = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Class") & F.col("s").startswith(namespace)).select(F.col("s").alias("focus")).distinct()
    marked = triples.filter(F.col("p") == base + "structural").select(F.col("s").alias("focus"))
    sourced = triples.filter((F.col("p") == PROV + "hadPrimarySource") & (F.col("o_kind") == "iri")).select(F.col("s").alias("focus"))
    return classes.join(marked, "focus", "left_anti").join(sourced, "focus", "left_anti")


def check_shape(triples: DataFrame, target_class: str, constraints: list[dict]) -> DataFrame:
    """(focus, path, rule): violations of property constraints on the instances of a class.

    A constraint: path, and any of min, max, node_kind, cls, datatype, pattern, values.
    """
    from kbspark.operators.compile import RDF

    kinds = triples.filter(F.col("p") == RDF + "type").select(F.col("s").alias("n"), F.col("o").alias("c"))
    focus = once(kinds.filter(F.col("c") == target_class).select(F.col("n").alias("focus")), ["focus"])
    out = None
    for c in constraints:
        values = focus.join(once(triples.filter(F.col("p") == c["path"]).withColumnRenamed("s", "focus"), ["focus", "o", "o_kind", "o_dt"], ["focus", "o"]), "focus", "left")
        per = values.groupBy("focus").agg(F.count("o").alias("n"))
        found = []
        if "min" in c:
            found.append(per.filter(F.col("n") < c["min"]).select("focus", F.lit("min").alias("rule")))
        if "max" in c:
            found.append(per.filter(F.col("n") > c["max"]).select("focus", F.lit("max").alias("rule")))
        have = values.filter("o is not null")
        tests = {"node_kind": lambda v: F.col("o_kind") == v, "datatype": lambda v: F.coalesce(F.col("o_dt") == v, F.lit(False)), "pattern": lambda v: F.col("o").rlike(v), "values": lambda v: F.col("o").isin(list(v))}
        found += [have.filter(~tests[k](c[k])).select("focus", F.lit(k).alias("rule")).distinct() for k in tests if k in c]
        if "cls" in c:
            found.append(have.join(kinds.filter(F.col("c") == c["cls"]).select(F.col("n").alias("o")), "o", "left_anti").select("focus", F.lit("cls").alias("rule")).distinct())
        for f in found:
            f = f.select("focus", F.lit(c["path"]).alias("path"), "rule")
            out = f if out is None else out.unionByName(f)
    return out if out is not None else focus.select("focus", F.lit("").alias("path"), F.lit("").alias("rule")).filter("false")
