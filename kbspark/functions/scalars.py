"""Scalar column functions of the knowledge base: identifiers, hashes, labels, paths.

All are built-in expressions except ``canonical_hash`` and ``html_extract``, whose semantics (JSON text with
sorted keys, HTML parsing) no built-in has; those are Arrow-batched.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File-name prefixes of entity notes.
ENTITY_PREFIXES = (
    "concept", "pattern", "antipattern", "technique", "framework", "oracle", "template", "instance", "process", "figure",
    "method", "policy", "task", "skill", "tool", "model", "metric", "use_case", "asset",
)
#: Entity types by the ending of a code symbol, first match wins.
SYMBOL_TYPES = (
    ("adapter", "Adapter"), ("runner", "Runner"), ("config", "Config"), ("db", "DataStore"), ("store", "DataStore"), ("cli", "CLI"),
    ("agent", "Agent"), ("event", "Event"), ("session", "Session"), ("plugin", "Plugin"), ("manager", "Manager"),
)
#: Wh per token by model, and for others.
POWER_RATES = {"gemma2:e4b": 0.00012, "gemma2:9b": 0.00018, "llama3.1:8b": 0.00018, "llama3.1:70b": 0.0011, "qwen2.5:7b": 0.00015, "qwen2.5:14b": 0.00029, "mistral:7b": 0.00015}
DEFAULT_POWER_RATE = 0.0001


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_underscores(c: Column) -> Column:
    return F.regexp_replace(c, "^_+|_+$", "")


def uri_kind(uri: Column) -> Column:
    """``url`` for http, https and file URIs, else ``md``."""
    return F.when(F.lower(uri).rlike("^(https?|file)://"), "url").otherwise("md")


def file_stem(path: Column) -> Column:
    """Last path part without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def uri_slug(uri: Column, size: int = 40) -> Column:
    """Slug of a URI: host and path for web URIs (no port, query or fragment), else the file stem."""
    web = F.lower(uri).rlike("^https?://")
    after = F.regexp_replace(uri, r"^[^:]*://", "")
    authority = F.regexp_extract(after, r"^[^/?#]*", 0)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/", "_")
    local = F.regexp_replace(uri, r"(?i)^file://[^/]*|[?#].*$", "")
    raw = F.lower(F.when(web, F.concat(host, F.lit("_"), path)).when(F.lower(uri).startswith("file://"), file_stem(local)).otherwise(file_stem(uri)))
    slug = F.substring(trim_underscores(F.regexp_replace(raw, "[^a-z0-9]+", "_")), 1, size)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("source"))


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def is_html(content_type: Column, head: Column) -> Column:
    """By content type, or by how the first 200 characters begin."""
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False)) | F.lower(F.regexp_replace(F.substring(head, 1, 200), r"(?U)^\s+", "")).rlike("^(<!doc|<html)")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_id(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def graph_slug(c: Column) -> Column:
    """Lower case; every character outside a-z, 0-9 and _ becomes _; no _ at the ends."""
    return trim_underscores(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"))


def registry_snake(c: Column) -> Column:
    """ASCII snake case; ``unknown`` if nothing is left."""
    snake = F.lower(trim_underscores(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_")))
    return F.coalesce(F.nullif(snake, F.lit("")), F.lit("unknown"))


def role_snake(c: Column) -> Column:
    """Unicode snake case of a role label."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)[^\w\s-]", ""), r"(?U)[\s-]+", "_"))


def iri_local(iri: Column) -> Column:
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def iri_namespace(iri: Column) -> Column:
    return F.substring(iri, F.lit(1), F.length(iri) - F.length(iri_local(iri)))


def source_iri(base: str, source: Column) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(source, "[^A-Za-z0-9._/-]", "_"))


def symbol_type(label: Column) -> Column:
    """Entity type of a code symbol by its ending."""
    low, out = F.lower(label), F.lit("CodeSymbol")
    for ending, kind in reversed(SYMBOL_TYPES):
        out = F.when(low.endswith(ending), kind).otherwise(out)
    return out


def confidence(value: Column, default: float = 0.7) -> Column:
    """A JSON value as double if it is a number; strings that look like numbers are not."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double")).otherwise(default)


def literal_kind(value: Column) -> Column:
    """``literal`` for booleans and numbers, ``iri`` for identifier-like strings, else ``literal`` (of JSON text)."""
    return F.when(value.rlike(r"^(true|false|-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?)$"), "literal").when(value.rlike(r"^[A-Za-z_][A-Za-z0-9_.\-]*$"), "iri").otherwise("literal")


def generated_block(text: Column, start: str, end: str) -> Column:
    """What lies between two markers; null unless both are there in order."""
    a = F.locate(start, text)
    tail = F.substring(text, a + len(start), F.length(text))
    b = F.locate(end, tail)
    return F.when((a > 0) & (b > 0), F.substring(tail, F.lit(1), b - 1))


def wikilink_id(target: Column) -> Column:
    """Id of the first ``[[id]]`` or ``[[id|label]]``; empty if there is none."""
    return strip(F.regexp_extract(target, r"\[\[([^\]|]+?)(?:\||\]\])", 1))


def label_tokens(label: Column, synonyms: Column) -> Column:
    """Distinct lower-cased words of a label and its synonyms."""
    every = F.concat(F.array(F.coalesce(label, F.lit(""))), F.coalesce(synonyms, F.array().cast("array<string>")))
    words = F.flatten(F.transform(every, lambda x: F.split(strip(F.lower(F.coalesce(x, F.lit("")))), r"(?U)\s+")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def is_entity_file(name: Column) -> Column:
    return name.rlike("^(" + "|".join(ENTITY_PREFIXES) + r")__.*\.md$") & ~is_anchor_file(name)


def is_anchor_file(name: Column) -> Column:
    return name.endswith("__class.md") | name.endswith("__hub.md")


def inferred_level(relative_dir: Column) -> Column:
    """``L`` and the depth of a directory below the root; the root is L0."""
    return F.concat(F.lit("L"), path_depth(relative_dir).cast("string"))


def path_depth(relative_dir: Column) -> Column:
    return F.when(relative_dir == "", 0).otherwise(F.size(F.split(relative_dir, "/")))


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, at = "", 0
    while at < len(glob):
        if glob[at : at + 2] == "**":
            out, at = out + ".*", at + 2
        elif glob[at] in "*?":
            out, at = out + ("[^/]*" if glob[at] == "*" else "[^/]"), at + 1
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return f"^{out}$"


def power_estimate(model: Column, tokens: Column, mode: Column) -> Column:
    """Wh of a number of tokens; 0 unless the mode is ``full``."""
    rate = F.lit(DEFAULT_POWER_RATE)
    for name, wh in POWER_RATES.items():
        rate = F.when(model == name, wh).otherwise(rate)
    return F.when(mode == "full", F.bround(rate * tokens, 6)).otherwise(F.lit(0.0))


def age_days(modified: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(modified)) / 86400.0


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces each ``{{NAME}}``."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def retryable(exit_code: Column) -> Column:
    return exit_code.between(64, 79)


def since(ts: Column, day: str) -> Column:
    """Timestamps on or after a day; what is missing or no date is kept."""
    found = F.try_to_date(F.substring(ts, 1, 10), "yyyy-MM-dd")
    return found.isNull() | (found >= F.lit(day).cast("date"))


def canonical_hash(fields: Column) -> Column:
    """SHA-256 of a struct as JSON with sorted keys, ``, `` and ``: `` between, and non-ASCII as it is."""
    return F.pandas_udf(_canonical, "string")(fields)


def _canonical(fields: pd.DataFrame) -> pd.Series:
    def plain(v):
        return [plain(x) for x in v] if hasattr(v, "tolist") and not isinstance(v, str) else v

    rows = fields.astype(object).where(fields.notna(), None).to_dict("records")
    return pd.Series([hashlib.sha256(json.dumps({k: plain(v) for k, v in r.items()}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for r in rows])


_DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
_BLOCKS = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "blockquote", "pre", "ul", "ol", "table"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.title, self.body = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _DROPPED
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag):
        self.hidden -= tag in _DROPPED and self.hidden > 0
        self.in_title = self.in_title and tag != "title"
        if tag in _BLOCKS:
            self.body.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.body.append(data)
            if self.in_title:
                self.title.append(data)


def parse_html(html: str | None) -> tuple[str, str]:
    """(title, text) of a page: scripts, styles and page furniture dropped, white space collapsed."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = re.sub(r"[ \t]+", " ", "".join(page.body))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text))
    return "".join(page.title).strip(), text.strip()


def html_extract(html: Column) -> Column:
    """struct<title, text> of HTML pages."""
    return F.pandas_udf(_pages, "struct<title:string,text:string>")(html)


def _pages(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in html:
        yield pd.DataFrame([parse_html(h) for h in batch], columns=["title", "text"])
