"""Operator 13: spelling variants among all words of a corpus, by a positional q-gram index.

Words are counted first: everything after works on distinct words. A pair of words one edit apart, the longer
of ``L`` characters, shares at least ``T = L - 2q + 1`` q-grams at places that differ by no more than their
lengths do; ``q`` follows from ``L`` so that ``T`` is at least two. Of each word only the q + 1 grams that are
rarest in the corpus are posted (any pair above the bound meets in one of them), under (length, gram, place);
the shorter words are posted for the next length at both places where an insertion may leave a gram. Postings
are dealt by ranges of (length, gram, place, word), so no list is one task's however long it is. A task merges
the sorted postings of a list's other grams for a block of words at once, counts the grams that two words
share within the place limits, keeps pairs that reach the bound, and verifies them character by character.

Lists longer than ``LONG_LIST`` and lists that a range cuts are not merged: their words meet by the strings
left when one character is deleted, where at most as many words meet as the alphabet has letters. Nothing is lost.

Defined cases: null texts have no words; rows are counted as they are, repeated ones too; a null doc_id is
written as nothing in front of the colon; words have three characters or more; extra columns are ignored; no words give no rows. Characters are
those of Latin-1, one byte each in the index.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, pick, release, small_batches, to_batch

#: A run of letters; the second form finds only runs of at least so many.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, DELETE_ONE_IN, RATIO = 7, 2, 31, 10
#: Longest gram, number of hashed grams, longest list that is merged; rows, and squares of lists' rows, merged together.
MOST_Q, GRAMS, LONG_LIST, BLOCK, PAIRS = 4, 1 << 20, 1000, 50_000, 4_000_000

OWN, SHORTER = 0, 1
_POSTING = pa.schema([("size", pa.int32()), ("gram", pa.int32()), ("place", pa.int32()), ("role", pa.int8()), ("w", pa.binary()), ("n", pa.int64())])
_PAIR = pa.schema([("size", pa.int32()), ("role", pa.int8()), ("a", pa.binary()), ("n_a", pa.int64()), ("b", pa.binary()), ("n_b", pa.int64())])


def gram_length(size: int) -> int:
    """The q for pairs whose longer word has ``size`` characters."""
    return max(1, min(MOST_Q, (size - 1) // 2))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, delete_one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, one in ``delete_one_in`` of them without one letter."""
    if least_length < 3:
        raise ValueError("the bound on shared grams needs words of three characters or more")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    # The checksum of a text is that of its UTF-8 bytes.
    h = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + F.lit(2), F.length("run")))
    words = h.select(F.when(F.col("h") % delete_one_in == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _matrices(batch: pa.RecordBatch):
    """(size, rows, matrix of characters) for each length of the words ``w`` of a batch."""
    column = pick(batch, "w").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    chars = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    sizes = np.diff(ends)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, chars[ends[:-1][rows][:, None] + np.arange(size)]


def _grams(matrix: np.ndarray, q: int) -> np.ndarray:
    """Hashed q-grams by place."""
    code = np.full((len(matrix), matrix.shape[1] - q + 1), q, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            code = (code << np.uint64(8)) + matrix[:, k : matrix.shape[1] - q + 1 + k].astype(np.uint64)
        code = code * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(44)).astype(np.int64)


def _count_grams(batches):
    """How often each hashed gram occurs: at most GRAMS rows a task."""
    total = np.zeros(GRAMS, dtype=np.int64)
    for batch in batches:
        for size, _, matrix in _matrices(batch):
            for q in {gram_length(size), gram_length(size + 1)}:
                total += np.bincount(_grams(matrix, q).ravel(), minlength=GRAMS)
    found = np.flatnonzero(total)
    for at in range(0, len(found), 100_000):
        part = found[at : at + 100_000]
        yield to_batch({"gram": part.astype(np.int32), "n": total[part]}, pa.schema([("gram", pa.int32()), ("n", pa.int64())]))


def _post(ranks):
    """Postings of the rarest grams of each word, for its own length and the next."""

    def run(batches):
        rank = ranks.value.astype(np.int64)
        for batch in batches:
            n = pick(batch, "n").to_numpy(zero_copy_only=False)
            w = pick(batch, "w")
            for size, rows, matrix in _matrices(batch):
                for role, target in ((OWN, size), (SHORTER, size + 1)):
                    q = gram_length(target)
                    if size < q:
                        continue
                    gram = rank[_grams(matrix, q)]
                    most = min(gram.shape[1], q + 1 - role)
                    best = np.sort((gram << 32) + np.arange(gram.shape[1]), axis=1)[:, :most]
                    which, best = np.repeat(np.arange(len(rows)), most), best.ravel()
                    for shift in range(1 + role):
                        place = (best & 0xFFFFFFFF) + shift
                        own = rows[which]
                        columns = {"size": np.full(len(own), target, dtype=np.int32), "gram": (best >> 32).astype(np.int32), "place": place.astype(np.int32), "role": np.full(len(own), role, dtype=np.int8), "w": w.take(pa.array(own)), "n": n[own]}
                        yield to_batch(columns, _POSTING)

    return run


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start - ends + n, n)


def _one_edit(longer: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows of two matrices are one replaced (equal widths) or one inserted character apart."""
    width = longer.shape[1]
    if other.shape[1] == width:
        return (longer != other).sum(axis=1) == 1
    same_front = np.cumprod(longer[:, :-1] == other, axis=1).sum(axis=1)
    same_back = np.cumprod((longer[:, 1:] == other)[:, ::-1], axis=1).sum(axis=1)
    return same_front + same_back >= width - 1


def _merge(size: int, group: np.ndarray, place: np.ndarray, role: np.ndarray, own: np.ndarray, shorter: np.ndarray):
    """Verified pairs of rows that share a list: (row of a word of ``size``, row of another such or of a shorter word).

    ``own`` and ``shorter`` are the character matrices of the two roles, in the order of their rows. The
    postings of all grams but the list's own are merged by sorting, and counted for every two rows they name.
    """
    q = gram_length(size)
    bound = size - 2 * q
    rows = [np.flatnonzero(role == r) for r in (OWN, SHORTER)]
    n_grams = size - q + 1

    def tokens(r: int, matrix: np.ndarray, shift: int):
        gram = _grams(matrix, q)
        at = np.arange(gram.shape[1]) + shift
        code = ((group[rows[r]][:, None] << 20) + gram) * (n_grams + 1) + at
        keep = at != place[rows[r]][:, None]
        return code[keep], np.nonzero(keep)[0]

    code, who = tokens(OWN, own, 0) if len(own) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    m = max(1, len(own))
    # Own words among themselves: each entry of a posting list with those behind it.
    behind = np.searchsorted(code, code, side="right") - np.arange(len(code)) - 1
    first = np.repeat(who, behind)
    second = who[_flat(np.arange(len(code)) + 1, behind)]
    pairs = np.minimum(first, second) * m + np.maximum(first, second)
    found, times = np.unique(pairs, return_counts=True)
    found = found[times >= bound]
    a, b = found // m, found % m
    good = _one_edit(own[a], own[b]) if len(a) else np.zeros(0, dtype=bool)
    yield rows[OWN][a[good]], rows[OWN][b[good]]
    if len(shorter) and len(own):
        met = []
        for shift in (0, 1):
            c, probe = tokens(SHORTER, shorter, shift)
            lo, hi = np.searchsorted(code, c, side="left"), np.searchsorted(code, c, side="right")
            met.append(np.repeat(probe, hi - lo) * m + who[_flat(lo, hi - lo)])
        found, times = np.unique(np.concatenate(met), return_counts=True)
        found = found[times >= bound]
        s, t = found // m, found % m
        good = _one_edit(own[t], shorter[s]) if len(s) else np.zeros(0, dtype=bool)
        yield rows[OWN][t[good]], rows[SHORTER][s[good]]


def _lists(batches):
    """Merge the lists inside a sorted range; hand on the words of long ones and of the first and the last."""

    def unmerged(table: pa.Table):
        for part in table.combine_chunks().to_batches(max_chunksize=20_000):
            none = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pick(part, "size"), pick(part, "role"), pick(part, "w"), pick(part, "n"), none, pa.nulls(part.num_rows, pa.int64())], schema=_PAIR)

    def merged(table: pa.Table):
        """``table``: whole lists of at most LONG_LIST rows each."""
        batch = table.combine_chunks().to_batches()[0]
        size, gram, place, n = (pick(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "gram", "place", "n"))
        role, w = pick(batch, "role").to_numpy(zero_copy_only=False), pick(batch, "w")
        group = np.cumsum(np.append(False, (size[1:] != size[:-1]) | (gram[1:] != gram[:-1]) | (place[1:] != place[:-1])))
        chars = {}
        for length, rows, matrix in _matrices(batch):
            chars[length] = (rows, matrix)
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            parts = []
            for r, length in ((OWN, s), (SHORTER, s - 1)):
                mine = rows[role[rows] == r]
                at, matrix = chars.get(length, (np.zeros(0, dtype=np.int64), np.zeros((0, length), dtype=np.uint8)))
                parts.append(matrix[np.searchsorted(at, mine)])
            for a, b in _merge(s, group[rows], place[rows], role[rows], *parts):
                if len(a):
                    a, b = rows[a], rows[b]
                    yield to_batch({"size": np.full(len(a), s, dtype=np.int32), "role": np.zeros(len(a), dtype=np.int8), "a": w.take(pa.array(a)), "n_a": n[a], "b": w.take(pa.array(b)), "n_b": n[b]}, _PAIR)

    first, skipped = True, None

    def settle(table: pa.Table, at_end: bool):
        """Settles all lists but the last, which may go on; returns the rows of that one while it may yet be merged."""
        nonlocal first, skipped
        keys = [table.column(c).to_numpy() for c in ("size", "gram", "place")]
        begins = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist()
        cut, last = first or skipped == tuple(int(k[0]) for k in keys), begins[-1]
        first = False
        if len(begins) > 1:
            if cut:
                yield from unmerged(table.slice(0, begins[1]))
                del begins[0]
            if begins[0] < last:
                yield from _by_length(table.slice(begins[0], last - begins[0]), np.diff(begins), unmerged, merged)
            cut = False
        rest = table.slice(last)
        if cut or at_end or rest.num_rows > LONG_LIST:
            skipped = tuple(int(k[-1]) for k in keys)
            yield from unmerged(rest)
            return None
        skipped = None
        return rest

    held = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= BLOCK:
                held = yield from settle(held, False)
    if held is not None:
        yield from settle(held, True)


def _by_length(table: pa.Table, lengths: np.ndarray, unmerged, merged):
    """Whole lists: those short enough are merged in blocks, the others handed on."""
    long = np.repeat(lengths > LONG_LIST, lengths)
    if long.any():
        yield from unmerged(table.filter(pa.array(long)))
        table, lengths = table.filter(pa.array(~long)), lengths[lengths <= LONG_LIST]
    at, ends, squares = 0, np.cumsum(lengths), np.cumsum(lengths.astype(np.int64) ** 2)
    while at < table.num_rows:
        # As many lists as fit into a block by their rows and by the pairs that they could form, one at least.
        first = int(np.searchsorted(ends, at, side="right"))
        done = squares[first - 1] if first else 0
        last = max(first, min(np.searchsorted(ends, at + BLOCK, side="right"), np.searchsorted(squares, done + PAIRS, side="right")) - 1)
        yield from merged(table.slice(at, int(ends[last]) - at))
        at = int(ends[last])
        release()


def _by_deletion(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs one edit apart among words (size, role, w, n) of the same size's lists."""
    w = words.withColumn("w", F.decode("w", "ISO-8859-1"))
    at = F.explode(F.sequence(F.lit(1), F.length("w"))).alias("at")
    cut = w.filter(F.col("role") == OWN).select("size", "w", "n", at)
    cut = cut.withColumn("rest", F.concat(F.substring(F.col("w"), F.lit(1), F.col("at") - F.lit(1)), F.substring(F.col("w"), F.col("at") + F.lit(1), F.length("w"))))
    # Equal rests with equal gaps: as many words as letters can stand in the gap.
    b = cut.select("size", "at", "rest", F.col("w").alias("b"), F.col("n").alias("n_b"))
    replaced = cut.join(b, ["size", "at", "rest"]).filter(F.col("w") < F.col("b")).select(F.col("w").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    short = w.filter(F.col("role") == SHORTER).select("size", F.col("w").alias("rest"), F.col("w").alias("b"), F.col("n").alias("n_b"))
    inserted = cut.drop("at").distinct().join(short, ["size", "rest"]).select(F.col("w").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    code = lambda c: F.encode(c, "ISO-8859-1").alias(c)
    return replaced.unionByName(inserted).select(code("a"), "n_a", code("b"), "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once each, of words (word, n) that are one edit apart; words in Latin-1 bytes."""
    spark = words.sparkSession
    small_batches(spark)
    coded = words.select(F.encode("word", "ISO-8859-1").alias("w"), "n")
    counts = coded.mapInArrow(_count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    # At most GRAMS rows, whatever the corpus: the rank of each hashed gram, rarest first.
    total = np.zeros(GRAMS, dtype=np.int64)
    total[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    ranks = np.empty(GRAMS, dtype=np.int32)
    ranks[np.argsort(total, kind="stable")] = np.arange(GRAMS, dtype=np.int32)
    sent = spark.sparkContext.broadcast(ranks)
    postings = materialise(coded.mapInArrow(_post(sent), "size int, gram int, place int, role byte, w binary, n long"), "postings")
    order = ["size", "gram", "place", "w"]
    dealt = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(_lists, "size int, role byte, a binary, n_a long, b binary, n_b long"), "pairs")
    discard(postings)
    rest = found.filter("b is null").select("size", "role", F.col("a").alias("w"), F.col("n_a").alias("n")).distinct()
    pairs = found.filter("b is not null").select("a", "n_a", "b", "n_b").unionByName(_by_deletion(rest))
    # The smaller of two words first.
    swap = F.col("b") < F.col("a")
    pairs = pairs.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("n_b", "n_a"), ("a", "b"), ("n_a", "n_b"))])
    return pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word (word, n).

    ``form``: the near word of largest n, the smallest of equals, if its n is at least ``ratio`` times the
    word's. Counts grow along forms, so following them ends; each round doubles the steps taken.
    """
    pairs = near_pairs(words)
    both = pairs.select("a", F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    near = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    near = near.select(text("a").alias("word"), "n_near", text("best.other").alias("other"), (-F.col("best.less")).alias("m"))
    has = F.col("m") >= ratio * F.col("n")
    out = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "forms")
    steps = out.filter("form is not null").select("word", F.col("form").alias("root"))
    was = None
    while True:
        # One step after the last of a chain there is nothing: then every word holds its root.
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = materialise(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(was)
        was, more = steps, steps.filter("moved").isEmpty()
        steps = steps.select("word", "root")
        if more:
            break
    return out.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text)."""
    return variants(materialise(word_counts(docs), "words"))
