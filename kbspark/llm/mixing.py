"""Operator 10: mixing sources to target weights by hierarchical budgeting.

Weights propagate down a tree of domain, language and source. At every node the budget is filled like
water: each child gets its share, at most its capacity (tokens times epochs), and what a child cannot use
goes to its siblings; only what a whole subtree cannot use reaches the level above, because a subtree's
capacity caps it there. Each leaf then takes whole seeded epochs and, of the last one, the prefix in seeded
order that begins before the budget is reached.

DataFrame expressions only. A leaf's prefix is found range by range: the token sums of 256 ranges of the seeded
order name the one with the cut, whose own 256 ranges are summed next, three times over; so a leaf with a third
of all rows is never one task, and what is ordered at last is one range in 16 million. Tokens are whatever the
``tokens`` column counts: the registered query takes white-space words, the pipeline the tokenizer's ids.

Defined cases: null domain, language or source count as the value ``(none)``; null and empty texts have no
tokens, and stand in an epoch like any other; documents whose seeded keys are equal (equal doc_id) are taken
or left together; nodes of weight zero get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, own_columns

LEVELS = ("domain", "language", "source")
#: Production parameters of the registered query and of the pipeline.
DOMAINS = ("web", "books", "code", "forums")
WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.25, "code": 0.2, "forums": 0.15},
    "language": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
    "source": {},
}
DEFAULT_WEIGHT = {"domain": 0.1, "language": 0.05, "source": 1.0}
SHARE, EPOCHS, SEED = 0.7, 2, "mix-1"


#: Digits of the seeded key that a round of ranges goes on by, and rounds.
DIGITS, ROUNDS = 2, 3


def n_tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The registered domain of a source: its number modulo four picks one of ``DOMAINS``."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", None).otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.try_to_number(number, F.lit("999999999")) % 4 + 1).cast("int")))


def seeded(doc_id: Column, epoch: Column, seed: str) -> Column:
    """Key of a document in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(float(DEFAULT_WEIGHT[level]))
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, float(w)).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, weights: dict, budget: Column, epochs: int) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with ``budget``: whole tokens for each leaf.

    The children of one node fill to a common level: min(capacity, weight x level), where the level is the
    largest of (budget - capacities of the fuller children) / (weights of the rest).
    """
    given = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    for at, level in enumerate(LEVELS):
        parents, keys = LEVELS[:at], LEVELS[: at + 1]
        nodes = given.groupBy(*keys).agg(F.sum("capacity").alias("cap")).withColumn("w", _weight(level, weights)).filter("w > 0")
        nodes = nodes.join(got, list(parents)) if at else nodes.withColumn("above", budget.cast("double"))
        part = Window.partitionBy(*parents) if at else Window.partitionBy(F.lit(0))
        order = part.orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("level", (F.col("above") - before) / rest)
        nodes = nodes.withColumn("fill", F.greatest(F.least(F.col("cap"), F.col("w") * F.max("level").over(part)), F.lit(0.0)))
        got = nodes.select(*keys, F.col("fill").alias("above"))
    return leaves.join(got, list(LEVELS)).withColumn("budget", F.floor(F.col("above") + 1e-6)).drop("above")


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("(none)"))


def plan_mix(documents: DataFrame, domain: Column, weights: dict, share: float, epochs: int, seed: str, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(narrow, plan): every document's leaf and tokens; each leaf's budget, whole epochs and last key.

    Of epoch ``whole`` a leaf takes the documents whose seeded key is at most ``cut``.
    """
    leaf = [_named(c).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS)]
    narrow = documents.select("doc_id", *leaf, (n_tokens(F.col("text")) if tokens is None else tokens).alias("n_tokens"))
    narrow = materialise(narrow, "narrow")
    leaves = materialise(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
    plan = leaf_budgets(leaves, weights, F.lit(int(total * share)), epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = materialise(plan.withColumn("rest", F.when(F.col("whole") >= epochs, 0).otherwise(F.col("rest"))), "plan")
    # The range that holds each leaf's cut, and the tokens before it.
    cut_in = plan.filter("rest > 0").select(*LEVELS, "whole", "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("range"))
    held, keyed = [], None
    for turn in range(ROUNDS):
        keyed = narrow.join(cut_in, list(LEVELS)).withColumn("h", seeded(F.col("doc_id"), F.col("whole"), seed))
        keyed = keyed.filter(F.substring("h", 1, DIGITS * turn) == F.col("range"))
        sums = keyed.withColumn("range", F.substring("h", 1, DIGITS * (turn + 1))).groupBy(*LEVELS, "whole", "rest", "before", "range").agg(F.sum("n_tokens").alias("n"))
        # At most 256 rows a leaf.
        ordered = Window.partitionBy(*LEVELS).orderBy("range")
        ahead = F.col("before") + F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("before", ahead).filter("before < rest").groupBy(*LEVELS, "whole", "rest").agg(F.max(F.struct("range", "before")).alias("at"))
        cut_in = materialise(last.select(*LEVELS, "whole", "rest", "at.before", "at.range"), "ranges")
        held.append(cut_in)
    keyed = narrow.join(cut_in, list(LEVELS)).withColumn("h", seeded(F.col("doc_id"), F.col("whole"), seed)).filter(F.substring("h", 1, DIGITS * ROUNDS) == F.col("range"))
    inside = keyed.groupBy(*LEVELS, "rest", "before", "h").agg(F.sum("n_tokens").alias("n"))
    ahead = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("ahead", ahead).filter("ahead < rest").groupBy(*LEVELS).agg(F.max("h").alias("cut"))
    out = materialise(plan.join(cuts, list(LEVELS), "left"), "cuts")
    discard(leaves, plan, *held)
    return narrow, out


def _selected(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``rows`` with the leaf columns of LEVELS, once for every epoch that takes them, as ``epoch``."""
    taken = rows.join(plan.select(*LEVELS, "whole", "cut"), list(LEVELS))
    last = F.when(seeded(F.col("doc_id"), F.col("whole"), seed) <= F.col("cut"), F.array("whole"))
    full = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1))
    none = F.array().cast("array<int>")
    return taken.withColumn("epoch", F.explode(F.concat(F.coalesce(full, none), F.coalesce(last, none)))).drop("whole", "cut")


def mix(documents: DataFrame, domain: Column, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, tokens: Column | None = None) -> DataFrame:
    """doc_id, epoch, domain, language, source, n_tokens of every selected document, once per epoch."""
    narrow, plan = plan_mix(documents, domain, weights, share, epochs, seed, tokens)
    return _selected(narrow, plan, seed).select("doc_id", "epoch", *LEVELS, "n_tokens")


def mixed_documents(documents: DataFrame, domain: Column, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, counted: DataFrame | None = None) -> DataFrame:
    """The selected rows of ``documents`` themselves, with all their columns, once per epoch; texts are not shuffled for it where the plan of the leaves is small enough for Spark to send it along.

    ``counted`` (doc_id, lang, source, n_tokens), a row for each of ``documents``, gives the tokens to plan by; else white-space words.
    """
    narrow, plan = plan_mix(documents if counted is None else counted, domain, weights, share, epochs, seed, None if counted is None else F.col("n_tokens"))
    discard(narrow)
    # The document's own columns travel as one struct, so no name can clash.
    rows = documents.select(F.struct(*own_columns(documents)).alias("row"), "doc_id", *[_named(c).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS)])
    return _selected(rows, plan, seed).select("row.*")


def oracle(seed: str = SEED) -> str:
    """DuckDB SQL with the rows of the registered query."""
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"

    def weight(level: str) -> str:
        arms = " ".join(f"when '{v}' then {w}::double" for v, w in WEIGHTS[level].items())
        return f"case {level} {arms} else {DEFAULT_WEIGHT[level]}::double end" if arms else f"{DEFAULT_WEIGHT[level]}::double"

    steps, above = [], f"select floor(sum(n_tokens) * {SHARE}::double) as above from narrow"
    for at, level in enumerate(LEVELS):
        keys, parents = ", ".join(LEVELS[: at + 1]), ", ".join(LEVELS[:at])
        part = f"partition by {parents}" if at else ""
        join = f"join g{at} using ({parents})" if at else "cross join g0"
        steps.append(f"""
    n{at} as (select {keys}, cap, w, above, sum(cap) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding) as cum,
                  sum(w) over ({part} order by cap / w, {level} rows between current row and unbounded following) as rw
          from (select {keys}, sum(tokens * {EPOCHS})::double as cap, {weight(level)} as w from leaves group by {keys}) {join}),
    l{at} as (select *, (above - coalesce(cum, 0)) / rw as lev from n{at}),
    g{at + 1} as (select {keys}, greatest(least(cap, w * max(lev) over ({part})), 0) as above from l{at})""")
    return f"""
    with narrow as (select doc_id, case when {number} = '' then '(none)' else coalesce([{names}][{number}::int % 4 + 1], '(none)') end as domain,
                           coalesce(lang, '(none)') as language, coalesce(source, '(none)') as source,
                           len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) as n_tokens from documents),
    leaves as (select domain, language, source, sum(n_tokens)::bigint as tokens from narrow group by all),
    g0 as ({above}),{",".join(steps)},
    plan as (select domain, language, source, tokens, least({EPOCHS}, floor(floor(above + 1e-6) / greatest(tokens, 1)))::int as whole, floor(above + 1e-6)::bigint as budget
             from g3 join leaves using (domain, language, source)),
    keyed as (select n.*, whole, budget - whole * tokens as rest, md5(concat_ws(':', '{seed}', whole::varchar, coalesce(doc_id::varchar, 'null'))) as h
              from narrow n join plan using (domain, language, source)),
    ahead as (select *, coalesce(sum(n_tokens) over (partition by domain, language, source order by h range between unbounded preceding and current row exclude group), 0) as before from keyed)
    select doc_id, e.epoch::int as epoch, domain, language, source, n_tokens::bigint as n_tokens from keyed, lateral (select unnest(range(whole)) as epoch) e
    union all
    select doc_id, whole, domain, language, source, n_tokens from ahead where whole < {EPOCHS} and before < rest
    """
