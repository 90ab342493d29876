"""Operator 8: secret scan by patterns and by token efficiency.

Base kinds: ``assign`` (a credential name, a separator and a value), ``access`` (access-key ids), ``hex``
(long hexadecimal runs). The method adds ``random``: runs of credential characters that a public tiktoken
vocabulary needs many tokens for, once known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512, CRC
runs), UUIDs, plain words, numbers and file or version identifiers are excluded. Runs without a digit are
tested like others. A part of 16 or more letters of one case, with or without a capital first letter, is a word only
if the vocabulary needs few enough tokens for it: its bound is a little lower, as rare words stand close to it.
Every span is reported, so base and random spans may overlap.

Defined cases: null and empty texts have no spans and the digest of the empty string; texts of any length
are scanned whole; repeated rows give repeated results; extra columns are ignored; offsets are code points,
end exclusive.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm.common import slices, small_batches, to_batch

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may be secrets: without a separator that prose or paths would have.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {16, 32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Identifiers: parts between separators, each one word or number, with few digits and only at its end.
_SEPARATORS = re.compile(r"[/_=+-]+")
_PART = re.compile(r"(?:[A-Za-z][a-z]*|[A-Z]+)[0-9]{0,4}|[0-9]+")
#: The words of a camel-case name; each pattern here reads a run once, whatever it holds.
_CAMEL_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HAS_LETTER = re.compile(r"[A-Za-z]")
#: Below this many characters a token a run counts as random.
CHARS_PER_TOKEN = 1.9
#: Letters from which a run of one case is not a word by its looks, and the ratio from which it is one.
LONG_WORD, WORD_CHARS_PER_TOKEN = 16, 1.8
_LETTERS = re.compile(r"[A-Za-z]+")

_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _identifier(bare: str, encoding) -> bool:
    parts = _SEPARATORS.split(bare)
    if not all(_PART.fullmatch(part) for part in parts):
        return False
    long = [m[0] for part in parts if (m := _LETTERS.match(part)) and len(m[0]) >= LONG_WORD]
    return all(len(w) >= WORD_CHARS_PER_TOKEN * len(encoding.encode_ordinary(w)) for w in long)


def _camel(bare: str) -> bool:
    """Two or more words of at least two small letters (or capitals) each, the first not of capitals, and up to three digits."""
    words = _CAMEL_WORD.findall(bare)
    if words and words[-1].isdigit():
        if len(words.pop()) > 3:
            return False
    if len(words) < 2 or words[0].isupper() or sum(map(len, words)) < len(bare) - 3:
        return False
    return all(w.isalpha() and len(w) >= (2 if w.isupper() or w.islower() else 3) for w in words)


def excluded(run: str, encoding) -> bool:
    """Known digests, UUIDs, numbers, words and identifiers: inefficient to encode, but no secrets."""
    bare = run.strip("=-_/+")
    if len(bare) < 16 or not _HAS_LETTER.search(bare):
        return True
    return bool(_UUID.match(bare) or _identifier(bare, encoding) or _camel(bare) or (_DIGEST.match(bare) and len(bare) in _DIGEST_SIZES))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base kinds, each leftmost and non-overlapping within its kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def random_spans(text: str, encoding, least: float = CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """Spans of runs whose characters-per-token ratio is under ``least`` and that are not excluded."""
    runs = [m for m in _RUN.finditer(text) if not excluded(m[0], encoding)]
    return [(m.start(), m.end(), "random") for m in runs if len(m[0]) < least * len(encoding.encode_ordinary(m[0]))]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(documents: DataFrame, vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of ``documents`` (doc_id, text); no shuffle."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        encoding = _encoding(vocabulary)
        for part in slices(batches, "text"):
            out = {f.name: [] for f in _ARROW}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                base = base_spans(text or "")
                more = random_spans(text or "", encoding, chars_per_token)
                out["doc_id"].append(doc_id)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in (*base, *more)))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(base + more))
            yield to_batch(out, _ARROW)

    small_batches(documents.sparkSession)
    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return docs.mapInArrow(run, _SCHEMA)
