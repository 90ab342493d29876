"""Operator 3: URL rules with redirect equivalence.

Longest matching host-and-path rule decides; else a URL that is connected to a blocked URL through redirect
(meta refresh, or given edges) and canonical-link edges is blocked too. An explicit allow rule of a URL
always keeps that URL. Of rules equally long the one of the longer host wins; of equal rules an allow wins:
the same order whether a rule list is short (one expression) or long (a join). Every canonical and refresh
tag outside comments and scripts is an edge. Everything is DataFrame expressions.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed; a
null html has no links; a comment or script that is never closed hides the rest of its page, a tag that is
never closed is none; repeated rows are judged alike; an empty table gives an empty result; extra columns
are ignored. Scheme and fragment do not tell two URLs apart as aliases; host (ASCII lower case), path and
query do. A link without a host is resolved against its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialise
from kbspark.llm.components import connected_components

#: Rule lists up to this long become one expression; longer ones are joined on host suffixes.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What tells a tag that links, and where in it the link stands, by the tag's name.
_LINKS = {
    "link": (r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""),
    "meta": (r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""),
}
#: Comments and scripts; one that is never closed hides the rest of its page.
_HIDDEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """Identity of a URL as an alias: host, path and query."""
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), query)


def _resolved(link: Column, url: Column) -> Column:
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) alias keys of the canonical links and refresh redirects that pages hold."""
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    found = pages.filter(html.rlike(r"(?i)canonical|refresh") & F.coalesce(url.contains("://"), F.lit(False)))
    seen = F.regexp_replace(html, _HIDDEN, " ")
    # What stands before each ``>``: a tag begins at its first opening there. No pattern looks across pieces, so work is linear in the page.
    pieces = F.split(seen, ">")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def targets(name: str) -> Column:
        tells, where = _LINKS[name]
        tags = F.filter(F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?is)<{name}\b(.*)", 1)), lambda t: t.rlike(tells))
        return F.transform(tags, lambda t: F.regexp_extract(t, where, 1))

    links = found.select("url", F.explode(F.concat(targets("link"), targets("meta"))).alias("link"))
    links = links.select(key_of(url).alias("src"), _resolved(F.col("link"), url).alias("to")).filter("to is not null")
    return links.select("src", key_of(F.col("to")).alias("dst")).filter("src <> dst")


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest (action, host, path) rule that fits ``host`` and ``path``."""
    # Equally long rules of equally long hosts that fit one URL are the same rule: then an allow goes first.
    rules = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow", r))
    if len(rules) <= INLINE_RULES:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for a, h, p in reversed(rules):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, a).otherwise(action)
        return df.withColumn("rule", rule).withColumn("action", action)
    listed = df.sparkSession.createDataFrame(rules, "action string, rule_host string, rule_path string")
    keys = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    order = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("action") == "allow")
    best = (
        keys.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(listed, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.concat("rule_host", "rule_path"), order).alias("rule"), F.max_by("action", order).alias("action"))
    )
    return df.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    ``edges`` (src_url, dst_url) adds redirects known from elsewhere.
    """
    pages = pages.select("page_id", "url", "html")
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(key_of(F.col("src_url")).alias("src"), key_of(F.col("dst_url")).alias("dst")))
    links = materialise(links.distinct(), "links")
    out = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key")), rules)
    if links.isEmpty():
        out = out.withColumn("blocked", F.lit(False))
    else:
        nodes = connected_components(links)
        ruled = with_rule(nodes.withColumn("host", F.regexp_extract("node", r"^[^/?#]*", 0)).withColumn("path", F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)), rules)
        bad = ruled.groupBy("component").agg(F.bool_or(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked")).filter("blocked")
        bad = ruled.join(bad, "component").select(F.col("node").alias("key"), "blocked")
        out = out.join(bad, "key", "left")
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The rules that the registered query applies.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _sql_parts(url: str) -> tuple[str, str, str]:
    rest = f"(case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return host, path, f"({host} || {path} || regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1))"


def oracle() -> str:
    """DuckDB SQL with the rows of the registered query."""
    host, path, key = _sql_parts("url")
    _, _, target = _sql_parts("target")
    q = lambda s: s.replace("'", "''")
    # One pattern for a whole tag: what tells it, anywhere in it.
    tag = {name: rf"(?is)<{name}\b[^>]*" + tells.removeprefix("(?is)") + "[^>]*>" for name, (tells, _) in _LINKS.items()}
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    rank = "1000000 * length(r.h || r.p) + 10 * length(r.h) + (r.action = 'allow')::int"
    fits = "(k.host = r.h or ends_with(k.host, '.' || r.h)) and starts_with(k.path, r.p)"
    return f"""
    with recursive rules(action, h, p) as (values {rules}),
    pg as (select page_id, url, regexp_replace(coalesce(html, ''), '{q(_HIDDEN)}', ' ', 'g') as seen, {host} as host, {path} as path, {key} as key from pages),
    raw as (
        select * exclude tag, regexp_extract(tag, '{q(_LINKS["link"][1])}', 1) as link from (select *, unnest(regexp_extract_all(seen, '{q(tag["link"])}')) as tag from pg)
        union all
        select * exclude tag, regexp_extract(tag, '{q(_LINKS["meta"][1])}', 1) as link from (select *, unnest(regexp_extract_all(seen, '{q(tag["meta"])}')) as tag from pg)),
    linked as (select key, host, regexp_replace(path, '[^/]*$', '') as folder, replace(link, '&amp;', '&') as link
               from raw where link <> '' and coalesce(contains(url, '://'), false)),
    aimed as (select key, case when contains(link, '://') then link when starts_with(link, '//') then 'http:' || link
                     when starts_with(link, '/') then 'http://' || host || link
                     else 'http://' || host || case when folder = '' then '/' else folder end || link end as target from linked),
    directed as (select distinct key as a, {target} as b from aimed where key <> {target}),
    edges as (select a, b from directed union select b, a from directed),
    nodes as (select distinct a as key, regexp_extract(a, '^[^/?#]*', 0) as host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) as path from edges),
    keys as (select host, path from nodes union select host, path from pg),
    best as (select host, path, arg_max(r.h || r.p, {rank}) as rule, arg_max(r.action, {rank}) as action
             from keys k join rules r on {fits} group by host, path),
    reached as (select n.key from nodes n join best b using (host, path) where b.action = 'block'
                union select e.b from reached join edges e on e.a = reached.key)
    select page_id, host, path, b.rule, coalesce(b.action, case when key in (select key from reached) then 'block' else 'allow' end) as verdict
    from pg left join best b using (host, path)
    """
