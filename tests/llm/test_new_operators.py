"""Operators 11 to 13 against brute force, on the tables and on hand-made rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import pytest

from kbspark.llm import align, linedup, variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h1 string, place int, w string")


def plain(rows):
    return [(i, t, "x", 7, None) for i, t in rows]


# --- 11: lines ------------------------------------------------------------------------------------------


def lines_by_hand(rows, chars=40, docs=5):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(linedup.STRIPPED).translate(LOWER)
    rank = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < docs or max(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


LICENSE = "this very line is part of a licence and has over forty characters"
LINE_ROWS = [
    (1, None), (2, ""), (3, "\n\n"), (None, LICENSE), (None, f"a\n{LICENSE}"), (4, LICENSE.upper() + " \t"), (5, f"\x0b{LICENSE}\r\nnext\n{LICENSE}"),
    (6, "\n".join([LICENSE] * 3000)), (7, f"{LICENSE}\nend\n{LICENSE}"), (7, f"{LICENSE}\nend\n{LICENSE}"), (7, LICENSE), (8, "x" * 200_000), (9, "É" * 40), (10, "é" * 40),
    *[(20 + i, f"shared by just four documents, which is not enough\n{i}") for i in range(4)], *[(30 + i, ("ü" * 40) + "\n" + "b" * 39) for i in range(9)],
]


def test_lines_as_by_hand(spark):
    got = linedup.line_dedup(docs_of(spark, plain(LINE_ROWS)))
    assert sorted(map(tuple, got.collect()), key=str) == lines_by_hand(LINE_ROWS)


def test_lines_as_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = duckdb.connect().execute(linedup.ORACLE.replace("from documents", f"from '{SF}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, linedup.line_dedup(docs).collect())) == sorted(want)


def test_no_lines(spark):
    assert linedup.line_dedup(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("ranges,batch", [(1, 1000), (7, 1), (60, 3), (300, 50)])
def test_runs_across_ranges(spark, ranges, batch):
    """Few rows a range and a batch: a run lies over many of both."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(old, (ranges, "false", batch)):
        spark.conf.set(k, v)
    try:
        rows = [(i, "\n".join(f"line number {k} of those that many documents hold" for k in range(i % 7, 9, 1 + i % 3)) + f"\n{LICENSE}") for i in range(80)]
        assert sorted(map(tuple, linedup.line_dedup(docs_of(spark, plain(rows))).collect()), key=str) == lines_by_hand(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmaps_are_small_and_whole(spark):
    rows = [(i, "\n".join([LICENSE] * 1000 + [str(i)])) for i in range(6)]
    found = {r.doc: r for r in linedup.keep_bitmaps(docs_of(spark, plain(rows))).collect()}
    assert set(found) == set(range(5)) and all(r.n_dropped == 1000 and len(r.keep) < 40 for r in found.values())
    assert linedup.kept_text(rows[3][1], bytes(found[3].keep)) == "3"


# --- 12: two tokenizers -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def spans(pieces):
    out, at = [], 0
    for x in pieces:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def alignment_by_hand(rows, files):
    """Token by token: every two spans compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_model.encode_special_tokens = True
    level = align._byte_level()

    def one(t):
        if not t:
            return None
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        pa = [bytes(level[c] for c in a_model.id_to_token(i)) for i in a]
        pb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if not b"".join(pa) == b"".join(pb) == f" {t}".encode():
            return None
        sa, sb = spans(pa), spans(pb)
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        groups, at = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            ids = [",".join(str(i) for i, (s, e) in zip(ids, sp) if at <= s and e <= cut) for ids, sp in ((a, sa), (b, sb))]
            groups.append("|".join(ids))
            at = cut
        return a, b, groups, links

    each = [(i, one(t)) for i, t in rows]
    count = collections.Counter(p for _, r in each if r for p in set(r[3]))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, r in each:
        if r is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links = r
            out.append((i, len(a), len(b), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [
    None, "", " ", " lead", "trail ", "  two  spaces\n\nand ", "a\tb<|endoftext|>x</s> y", "▁ under ▁x", "日本語 é ﬁ　wide 😀😀", "\x00\x01", "<unk> <s> <0x41>\r\nq", "x" * 3000, "same same same", "same same same", "don't we're it's", "é​﻿",
]


@pytest.mark.parametrize("known", [align.KNOWN, 40, 0])
def test_alignment_as_by_hand(spark, files, known):
    rows = [*enumerate(ODD), (3, "same same same"), (None, "Some text.")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("n_chars < 600").collect()]
    got = align.token_alignment(docs_of(spark, plain(rows)), *files, known)
    assert sorted(map(tuple, got.collect()), key=str) == alignment_by_hand(rows, files)


def test_no_alignment(spark, files):
    assert align.token_alignment(docs_of(spark, []), *files).collect() == []


# --- 13: words ---------------------------------------------------------------------------------------------


def words_by_hand(rows):
    count = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def near_by_hand(words):
    """Every two words compared."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    found = collections.defaultdict(set)
    for a in words:
        for b in (*by_size[len(a)], *by_size[len(a) + 1]):
            if near(a, b):
                found[a].add(b)
                found[b].add(a)
    return found


def variants_by_hand(words):
    near, form = near_by_hand(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


TEXTS = [
    (1, "spelling " * 2000 + "Spellings SPELLINGS speling speling spelling-spellings"), (2, "spellingsx spellingsx " * 2 + "speling " * 30), (3, None), (4, ""), (None, "été_étérnité étérnité eternité eternité"),
    (5, "aaaaaaaa " * 40 + "aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa aaabaaaa aaabaaaa " + "a" * 30_000 + " " + "a" * 30_000 + " " + "a" * 30_001 + " " + "a" * 30_001),
    (5, "chain abcdefgh abcdefgh " + "abcdefgi " * 20 + "abcdefji " * 200 + "abcdekji " * 2000 + "ÿÿÿÿÿÿÿ " * 3 + "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ×××÷÷÷÷ ×××÷÷÷÷"),
]


@pytest.mark.parametrize("longest", [variants.LONG_LIST, 3, 0])
def test_words_as_by_hand(spark, monkeypatch, longest):
    """Also with lists that are too long to merge, some and all of them."""
    monkeypatch.setattr(variants, "LONG_LIST", longest)
    own = [(i, t[:60_000] if longest < 100 and t else t) for i, t in TEXTS if longest == variants.LONG_LIST or i != 5 or "chain" in t]
    rows = own + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = variants.spelling_variants(docs_of(spark, plain(rows)))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == variants_by_hand(words_by_hand(rows))


@pytest.mark.parametrize("batch,block", [(1, 1), (3, 40), (100, 10**6)])
def test_lists_in_any_batches(spark, monkeypatch, batch, block):
    import random

    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(3, 10))): draw.randint(2, 500) for _ in range(1200)}
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "LONG_LIST", 60)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = variants.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pairs = [(bytes(r.a).decode("latin-1"), r.n_a, bytes(r.b).decode("latin-1"), r.n_b) for r in got]
    assert sorted(pairs) == sorted((a, words[a], b, words[b]) for a, others in near_by_hand(words).items() for b in others if a < b)


def test_no_words(spark):
    assert variants.spelling_variants(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        variants.word_counts(docs_of(spark, []), least_length=2)
