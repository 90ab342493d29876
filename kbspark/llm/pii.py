"""Operator 2: personal data replaced by keyed, type-consistent surrogates.

Entities: e-mail addresses, phone numbers, payment-card and account numbers, IBANs, IPv4 addresses, and
persons: names after a title, a known given name with a surname, and every later or earlier mention in the
same document of a name so found, whole or surname alone. Names are replaced word by word, so "Mr. John
Smith", "John Smith" and "Mr. Smith" stay one person; a phone number keeps its surrogate with and without its
country code. An entity's value is normalised (coreference: the same value gets the same surrogate in every
document and format); a keyed hash of type, value and attempt draws the surrogate, which keeps type, length
class, script, gender, check digits and, when written back, the separators and the case of each mention. A
distributed check compares surrogates as they are written, of one type whatever their gender, with each other
and with all real values; all but one of those that are equal draw again until none are. After LENGTHEN
attempts surrogates grow longer, so the check ends however many values of one shape there are; only IPv4
addresses cannot grow, and an error says so when their space is used up.

The key is an argument without default: whoever knows it can compute the table of surrogates.

Texts are scanned once; the documents with their entities are written, and only those with entities take part
in the joins. Spans are code points of the original text, end exclusive.

Defined cases: null texts stay null and empty ones empty, with no entity; texts are scanned whole; repeated
rows are treated alike; overlapping entities are resolved to the leftmost, longest first by type order; an
empty table gives an empty result; columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, slices, small_batches, to_batch

#: Attempts before surrogates grow longer, and at which an address space counts as used up.
LENGTHEN, MOST = 4, 400

#: Name pools by gender and script.
NAMES = {
    ("m", "latin"): "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah".split(),
    ("m", "cyrillic"): "Александр Дмитрий Максим Сергей Андрей Алексей Артём Илья Кирилл Михаил Никита Матвей Роман Егор Арсений Иван".split(),
    ("f", "cyrillic"): "Анастасия Мария Дарья Анна Елизавета Виктория Полина Варвара Екатерина Софья Александра Ксения Вероника Арина Алиса Ольга".split(),
    ("n", "latin"): "Alex Robin Kim Jordan Taylor Morgan Casey Riley Jamie Avery Quinn Rowan Sasha Dana Jules Marion".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Паша Юля Шура Тоня".split(),
    ("l", "latin"): "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Thomas Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Hill Green Adams Baker Nelson".split(),
    ("l", "cyrillic"): "Иваненко Петренко Сидоренко Коваленко Бондаренко Ткаченко Кравченко Шевченко Бойко Мельник Лисенко Марченко Руденко Савченко Левченко Мороз".split(),
}
#: Titles that tell a person's gender.
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Госпожа": "f"}
#: Titles that do not.
TITLES |= dict.fromkeys(("Dr", "Prof", "Doctor", "Professor", "Rev", "Доктор", "Профессор"), "n")
#: Given names that tell a person without a title, with the gender that they tell.
GIVEN = {name: g for (g, _), names in NAMES.items() if g != "l" for name in names}

PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]*[\w+]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])")),
]
_NAME = r"[^\W\d_a-z][^\W\d_]+"
_AFTER_TITLE = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\.?\x20({_NAME}(?:[ -]{_NAME}){{0,2}})(?!\w)")
_CAPITALISED = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_TITLE_WORD = re.compile("|".join(sorted(TITLES, key=len, reverse=True)))
_ORDER = {kind: i for i, kind in enumerate([*(k for k, _ in PATTERNS), "given", "surname"])}


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it valid."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(bban: str, country: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def script_of(word: str) -> str:
    """Script of a word's first letter: the first word of its Unicode name (latin, cyrillic, greek, cjk, ...)."""
    return next((unicodedata.name(c, "latin").split()[0].lower() for c in word if c.isalpha()), "latin")


def _person(words: list[tuple[int, int, str]], gender: str) -> list[tuple[int, int, str, str]]:
    """Mentions of a name's words: all but the last are given names."""
    if gender == "n" and len(words) > 1:
        gender = GIVEN.get(words[0][2].capitalize(), "n")
    given = [(a, b, "given", f"{gender}|{script_of(w)}|{w.lower()}") for a, b, w in words[:-1]]
    a, b, w = words[-1]
    return [*given, (a, b, "surname", f"l|{script_of(w)}|{w.lower()}")]


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """Given names and surnames: after titles, after known given names, and wherever else in the text these names stand."""
    found, named = [], {}

    def note(words, gender):
        parts = _person(words, gender)
        found.extend(parts)
        named.setdefault(words[-1][2].lower(), {}).update({w.lower(): p[3] for p, (_, _, w) in zip(parts, words[:-1])})

    words_in = lambda a, b: [(m.start(), m.end(), m[0]) for m in _CAPITALISED.finditer(text, a, b)]
    if _TITLE_WORD.search(text):
        for m in _AFTER_TITLE.finditer(text):
            words = [(m.start(2) + w.start(), m.start(2) + w.end(), w[0]) for w in re.finditer(r"[^ -]+", m[2])]
            note(words, TITLES[m[1]])
    if any(map(text.__contains__, GIVEN)):
        every = words_in(0, len(text))
        at = 0
        while at < len(every) - 1:
            a, b, w = every[at]
            if w in GIVEN and text[b : every[at + 1][0]] == " ":
                to = at + 1
                # A second given name before the surname.
                if every[to][2] in GIVEN and to + 1 < len(every) and text[every[to][1] : every[to + 1][0]] == " ":
                    to += 1
                note(every[at : to + 1], GIVEN[w])
                at = to
            at += 1
    if named:
        taken = {p[0] for p in found}
        before = None
        for a, b, w in words_in(0, len(text)):
            given = named.get(w.lower())
            if given is not None:
                if a not in taken:
                    found.append((a, b, "surname", f"l|{script_of(w)}|{w.lower()}"))
                if before and before[0] not in taken and text[before[1] : a] == " " and before[2].lower() in given:
                    found.append((before[0], before[1], "given", given[before[2].lower()]))
            before = (a, b, w)
    return sorted(set(found))


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normalised value) of the entities of a text, without overlaps."""
    found = persons(text)
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "phone" and sum(c.isdigit() for c in m[0]) < 9:
                continue
            if kind == "iban":
                raw = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
                    continue
            found.append((*m.span(), kind, _normal(kind, m[0])))
    out, at = [], 0
    for a, b, kind, value in sorted(found, key=lambda s: (s[0], -s[1], _ORDER[s[2]])):
        if a >= at:
            out.append((a, b, kind, value))
            at = b
    return out


#: Country codes of one and of two digits; all others have three.
_CODES_OF_ONE = "1 7".split()
_CODES_OF_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return digits[: 1 if digits[:1] in _CODES_OF_ONE else 2 if digits[:2] in _CODES_OF_TWO else 3]


def _normal(kind: str, surface: str) -> str:
    digits = "".join(c for c in surface if c.isdigit())
    if kind == "phone":
        # The national number is who, the country code is where: numbers with and without it are one value.
        return digits[len(country_code(digits)) :] if surface.startswith("+") else digits[-10:]
    if kind == "card":
        return digits
    return surface.replace(" ", "") if kind == "iban" else surface.lower()


class _Draws:
    """A keyed stream of numbers for one (type, value, attempt)."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        while len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n


@functools.lru_cache(maxsize=4096)
def _peers(c: str) -> str:
    """Letters of the same block of 128 code points and the same case."""
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base, kind = ord(c) & ~0x7F, (unicodedata.category(c), script_of(c))
    return "".join(x for x in map(chr, range(base, base + 128)) if (unicodedata.category(x), script_of(x)) == kind and x.lower().islower() == c.lower().islower() and len(x.upper()) == len(x.lower()) == 1)


def _like(c: str, draw: _Draws) -> str:
    """A character of the same class: a digit, or a letter of its script and case; others stay."""
    if c.isdecimal():
        return chr(ord(c) - int(c) + draw.below(10))
    if not c.isalpha():
        return c
    peers = _peers(c) or c
    return peers[draw.below(len(peers))]


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The normalised surrogate of a normalised value at one attempt."""
    draw, more = _Draws(key, kind, value, attempt), max(0, attempt - LENGTHEN)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(_like(c, draw) for c in local + "a" * more) + "@" + "".join(_like(c, draw) for c in host) + "." + top
    if kind == "card":
        body = str(1 + draw.below(9)) + "".join(str(draw.below(10)) for _ in range(len(value) - 2 + more))
        valid = luhn_digit(value[:-1]) == value[-1]
        check = luhn_digit(body)
        return body + (check if valid else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        return "".join(str(draw.below(10)) for _ in range(len(value) + more))
    if kind == "iban":
        bban = "".join(_like(c, draw) for c in value[4:] + "0" * more)
        return value[:2] + iban_check(bban, value[:2]) + bban
    if kind == "ip":
        if attempt > MOST:
            raise ValueError("more addresses than there are surrogates for: the space of IPv4 addresses is used up")
        first = value.split(".")[0]
        return ".".join([first if first in ("10", "127", "192", "172") and not more else str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(3))])
    gender, script, name = value.split("|", 2)
    pool = NAMES.get((gender, script))
    if pool and attempt < LENGTHEN:
        new = pool[draw.below(len(pool))].lower()
    elif pool:
        # The pools are finite: later attempts lengthen a name until it is free.
        new = pool[draw.below(len(pool))].lower()
        new += "".join(_like(new[-1], draw) for _ in range(1 + more))
    else:
        new = "".join(_like(c, draw) for c in name + name[-1] * more)
    return f"{gender}|{script}|{new}"


def written(kind: str, value: str) -> str:
    """What two values of one space must not share: for names, the name alone, given or not and of any gender."""
    return value.rpartition("|")[2] if kind in ("given", "surname") else value


def rendered(kind: str, surface: str, value: str) -> str:
    """A normalised surrogate written the way ``surface`` is."""
    if kind in ("card", "phone"):
        # The last digits are the value's; a country code before them stays. Digits beyond the format follow it.
        n = sum(c.isdigit() for c in surface)
        digits, at, out = value, 0, []
        keep = max(0, n - len(value)) if kind == "phone" else 0
        for c in surface:
            if c.isdigit() and keep:
                keep -= 1
                out.append(c)
            elif c.isdigit():
                out.append(digits[at])
                at += 1
            else:
                out.append(c)
        return "".join(out) + digits[at:]
    if kind == "iban":
        chars = iter(value)
        return "".join(c if c == " " else next(chars) for c in surface) + "".join(chars)
    if kind in ("given", "surname"):
        name = written(kind, value)
        return name.upper() if len(surface) > 1 and surface.isupper() else name[0].upper() + name[1:]
    if kind == "email" and len(value) == len(surface):
        return "".join(v.upper() if s.isupper() else v for s, v in zip(surface, value))
    return value.upper() if surface.isupper() else value


_MENTION = "array<struct<start:int,end:int,type:string,value:string>>"
_MENTION_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))


def _detect(batches):
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("mentions", _MENTION_ARROW)])
    for part in slices(batches, "text"):
        texts = part.column("text").to_pylist()
        found = [[dict(zip(("start", "end", "type", "value"), m)) for m in mentions(t or "")] for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(found, _MENTION_ARROW)], schema=kinds)


def _draw(key: bytes):
    kinds = pa.schema([("type", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("surrogate", pa.string()), ("space", pa.string()), ("written", pa.string())])

    def run(batches):
        for b in batches:
            rows = [b.column(c).to_pylist() for c in ("type", "value", "attempt")]
            drawn = [surrogate(*r, key) for r in zip(*rows)]
            spaces = ["name" if t in ("given", "surname") else t for t in rows[0]]
            yield to_batch(dict(zip(kinds.names, (*rows, drawn, spaces, [written(t, s) for t, s in zip(rows[0], drawn)]))), kinds)

    return run


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, value, attempt, surrogate) for each distinct (type, value): no two of a type are written alike, none like a real value."""
    kinds = "type string, value string, attempt int, surrogate string, space string, written string"
    known = materialise(entities.select("type", "value").distinct(), "entities")
    space = F.when(F.col("type").isin("given", "surname"), "name").otherwise(F.col("type"))
    name = F.when(space == "name", F.substring_index("value", "|", -1)).otherwise(F.col("value"))
    taken = materialise(known.select(space.alias("space"), name.alias("written")).distinct(), "taken")
    now = materialise(known.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), kinds), "surrogates")
    while True:
        me = F.struct("attempt", "type", "value")
        shared = now.groupBy("space", "written").agg(F.min(me).alias("first"), F.count("*").alias("n")).filter("n > 1")
        clash = now.join(shared, ["space", "written"]).filter(me != F.col("first")).select("type", "value")
        real = now.join(taken, ["space", "written"], "left_semi").select("type", "value")
        losers = materialise(clash.unionByName(real).distinct(), "losers")
        if losers.isEmpty():
            discard(known, taken, losers)
            return now.select("type", "value", "attempt", "surrogate")
        again = now.join(losers, ["type", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1).select("type", "value", "attempt")
        before, now = now, materialise(now.join(losers, ["type", "value"], "left_anti").unionByName(again.mapInArrow(_draw(key), kinds)), "surrogates")
        discard(before, losers)


def _replace(batches):
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("entities", pa.string())])
    for part in slices(batches, "text"):
        out = {f.name: [] for f in kinds}
        for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            pieces, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                pieces += [text[at : s["start"]], rendered(s["type"], text[s["start"] : s["end"]], s["surrogate"])]
                at = s["end"]
            out["doc_id"].append(doc_id)
            out["text"].append("".join(pieces) + text[at:])
            out["n_entities"].append(len(spans))
            out["entities"].append(",".join(f"{s['type']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: s["start"])))
        yield to_batch(out, kinds)


def pseudonymise(documents: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (type:start:end of the original) of every row of ``documents``."""
    if not key:
        raise ValueError("surrogates need a key")
    small_batches(documents.sparkSession)
    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    held = docs.mapInArrow(_detect, f"doc_id long, text string, mentions {_MENTION}")
    held = materialise(held.withColumn("row", F.monotonically_increasing_id()), "mentions")
    spans = held.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    table = assign_surrogates(spans, key)
    done = spans.join(table.drop("attempt"), ["type", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "end", "type", "surrogate")).alias("spans"))
    out = "doc_id long, text string, n_entities long, entities string"
    changed = held.filter(F.size("mentions") > 0).select("row", "doc_id", "text").join(done, "row").select("doc_id", "text", "spans").mapInArrow(_replace, out)
    same = held.filter(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    return changed.unionByName(same)


def session_key(spark) -> bytes:
    """The key in ``spark.kbspark.pii.key``; where that is unset one drawn for this session, unknown to anybody."""
    name = "spark.kbspark.pii.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()
