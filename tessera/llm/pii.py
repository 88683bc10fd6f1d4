"""Personal data: every detected entity gets a keyed surrogate of its own type and format.

Entities: e-mail addresses, telephone numbers, IPv4 addresses, payment cards, US
social security numbers, secrets (access keys, password and token values), and names behind a
title, with the places where such a name stands alone in the same text.  Mentions are reduced to a canonical form (digits of a
telephone number, lower case of an address), so one person keeps one surrogate in
all documents and spellings; the surrogate is rendered in the format of each
mention: digits for digits, case for case, separators as they are.  Surrogate names are
built from lists of parts and keep gender (that of the titles before a given name over all texts, neutral if they
disagree or tell none) and script; international numbers keep their country code; cards keep a valid check digit; octets of an address
stay in range.

A surrogate is a function of (key, type, canonical form, attempt) by HMAC-SHA-256.
Over all distinct entities of the corpus two checks are made: no two entities may
share a surrogate, and no surrogate may be a real entity.  Who fails moves alone to the
next attempt until all pass.  From attempt ``ATTEMPTS`` on, the format counts as exhausted and surrogates are
longer than it, by more the later the attempt (addresses first take octets of any width), so all pass in the end.  Attempts above 0 are exceptions: up to ``BROADCAST`` of
them are broadcast; beyond that they are joined to the rows that need them.

Defined cases: null text stays null, empty text stays empty; rows with null or
repeated ids are treated like any other; an empty table gives an empty result; all
other columns are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, packed, row_slices, session_of, slices, stash

BROADCAST, ATTEMPTS = 100_000, 64

# Titles by gender, and surrogate names by script and gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Doña", "Госпожа"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"),
    "n": ("Dr", "Prof", "Mx"),
}
#: Surrogate names are built of one part of each list: stem, middle, ending.
GIVEN = {
    "latin": {
        "stem": ("Al", "Bel", "Cal", "Dor", "El", "Fin", "Gal", "Hel", "Il", "Jul", "Kar", "Lor", "Mar", "Nel", "Or", "Per", "Ros", "Sel", "Tal", "Val"),
        "middle": ("", "an", "ar", "ed", "el", "en", "in", "is", "on", "or"),
        "f": ("a", "ia", "ina", "ette"),
        "m": ("o", "us", "ert", "win"),
        "n": ("y", "i", "ey", "is"),
    },
    "cyrillic": {
        "stem": ("Ал", "Бор", "Вал", "Гал", "Дар", "Ел", "Зар", "Ил", "Кир", "Лар", "Мар", "Ник", "Ол", "Пол", "Рос", "Сел"),
        "middle": ("", "ан", "ен", "ин", "он"),
        "f": ("а", "ия", "ина"),
        "m": ("ий", "ис", "ор"),
        "n": ("и", "ель", "ан"),
    },
    "greek": {
        "stem": ("Αλ", "Βασ", "Δαν", "Ελ", "Θεο", "Καλ", "Λεο", "Μαρ", "Νικ", "Ορ", "Πετ", "Σοφ"),
        "middle": ("", "αν", "ιν", "ων"),
        "f": ("ία", "ίνα", "ώ"),
        "m": ("ος", "ης", "ίας"),
        "n": ("ι", "έλ", "ις"),
    },
}
FAMILY = {
    "latin": (
        ("Al", "Bar", "Bren", "Cal", "Cor", "Dal", "Den", "Ed", "El", "Far", "Gar", "Hal", "Har", "Jen", "Kel", "Lam", "Lin", "Mar", "Mor", "Nor", "Ol", "Par", "Quin", "Ros", "Sel", "Tal", "Tur", "Vel", "Wal", "Wes"),
        ("", "a", "am", "an", "ber", "de", "den", "der", "e", "en", "er", "ga", "gen", "ing", "ken", "la", "len", "man", "mer", "ne", "ner", "o", "ren", "ri", "sen", "ta", "ter", "va", "ven", "wen"),
        ("berg", "bury", "by", "cott", "dale", "feld", "ford", "ham", "hart", "holm", "ington", "kins", "land", "ley", "lund", "mann", "mond", "ner", "quist", "ridge", "ston", "stein", "thorpe", "ton", "vale", "ville", "wald", "well", "wick", "worth"),
    ),
    "cyrillic": (
        ("Бел", "Вол", "Гор", "Дем", "Ер", "Жар", "Зим", "Кал", "Лав", "Мир", "Нов", "Ор", "Пав", "Род", "Сав", "Тит", "Фад", "Хол", "Чер", "Шар"),
        ("", "ан", "ат", "ев", "ен", "ер", "ил", "им", "ин", "ит", "об", "од", "ол", "он", "ос", "от", "ов", "уш", "ын", "яг"),
        ("ов", "ев", "ин", "ский", "енко", "цев", "ицын", "ников"),
    ),
    "greek": (
        ("Αλεξ", "Βασ", "Γεωρ", "Δημ", "Καρ", "Κων", "Λαμπ", "Μαν", "Νικολ", "Παπ", "Πετρ", "Στεφ"),
        ("", "αν", "αρ", "ελ", "ιδ", "ιν", "ολ", "ορ"),
        ("όπουλος", "άκης", "ίδης", "άτος", "έας", "ίου"),
    ),
}
# Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_RULES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?=[_\-+/.]*[A-Za-z0-9])[A-Za-z0-9_\-+/.]{6,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": rf"\b(?:{_TITLE})\b\.? +[^\W\d_a-zа-я]\w+(?: [^\W\d_a-zа-я]\w+)?",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _RULES.items()))
_CARD = r"(?<![\w-])(?:\d{16}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?![\w-])"
_WHOLE_CARD = re.compile(_CARD)
_INSIDE = re.compile("|".join(f"(?P<{k}>{_CARD if k == 'card' else v})" for k, v in _RULES.items()))
_MAYBE = re.compile(rf"[@\d=:]|\b(?:{_TITLE})\b")
_VALUE = re.compile(r"^(.*?[=:]\s*[\"']?)(.*)$", re.S)


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _matches(text: str):
    """Matches of the rules, left to right.

    A card is a number with a right check digit, or one of 16 digits that stand alone, in fours, or begin with 3 to 6.
    What looks like a card and is none is searched again by the other rules and for a card inside.
    """
    at = 0
    while m := _ANY.search(text, at):
        if m.lastgroup == "card" and not luhn(digits := re.sub(r"\D", "", m.group())):
            s, e = m.span()
            inner = _WHOLE_CARD.search(text, s)
            while inner and inner.start() < e and not luhn(re.sub(r"\D", "", inner.group())):
                inner = _WHOLE_CARD.search(text, inner.start() + 1)
            if inner and inner.start() < e:
                m = _INSIDE.search(text, s)  # what precedes the card inside, or that card
                m = m if m.end() <= inner.start() else inner
                yield m, m.lastgroup or "card"
                at = m.end()
                continue
            if not (len(digits) == 16 and (digits[0] in "3456" or _WHOLE_CARD.fullmatch(m.group()))):
                m = _INSIDE.search(text, s)
                if m is None or m.start() >= e:
                    at = e
                    continue
        yield m, m.lastgroup
        at = m.end()


def _script(name: str) -> str:
    return "cyrillic" if re.search(r"[\u0400-\u04ff]", name) else "greek" if re.search(r"[\u0370-\u03ff\u1f00-\u1fff]", name) else "latin"


def _code(digits: str) -> int:
    """How many digits of an international number are its country code."""
    return next((n for n in (1, 2) if digits[:n] in CODES), 3)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, type, canonical form) of the entities of a text, left to right.

    A name gives one entity for each part, so that "Mrs Ada King" and "Mrs King" share the family name; where
    a part stands alone elsewhere in the text, with a capital, it is the same entity.
    """
    out, names = [], {}
    if not _MAYBE.search(text):
        return out
    for m, kind in _matches(text):
        s, e, raw = m.start(), m.end(), m.group()
        if kind == "name":
            title, *parts = re.split(r"(?:\. +|\.| +)", raw)
            gender, at = _GENDER.get(title, "n"), s
            for i, p in enumerate(parts):
                at = text.index(p, at if i else s + len(title))
                role = "family" if i == len(parts) - 1 else "given"
                what = f"{role}_{_script(p)}" + (f"_{gender}" if role == "given" else "")
                names.setdefault(p.casefold(), what)
                out.append((at, at + len(p), what, p.casefold()))
                at += len(p)
            continue
        digits = re.sub(r"\D", "", raw)
        if kind == "email":
            out.append((s, e, kind, raw.lower()))
        elif kind == "secret":
            v = None if raw.startswith("AKIA") else _VALUE.match(raw)
            s += len(v[1]) if v else 0
            out.append((s, e, kind, text[s:e]))
        elif kind == "card":
            out.append((s, e, kind, digits))
        elif kind == "phone":
            if 7 <= len(digits) <= 15:
                national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
                out.append((s, e, kind, f"+{digits}" if raw.startswith("+") and national == digits else national))
        else:
            out.append((s, e, kind, digits if kind == "ssn" else raw))
    if names:
        alone = re.compile(r"(?<![\w@.-])(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?!\w|@)", re.I)
        taken = sorted((s, e) for s, e, _, _ in out)
        starts = [s for s, _ in taken]
        for m in alone.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            inside = (k >= 0 and taken[k][1] > m.start()) or (k + 1 < len(taken) and taken[k + 1][0] < m.end())
            if m.group()[0].isupper() and not inside and (what := names.get(m.group().casefold())):
                out.append((m.start(), m.end(), what, m.group().casefold()))
        out.sort()
    return out


class Draw:
    """An endless keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.block, self.left = (key, f"{kind}\0{canonical}\0{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.seed[0], self.seed[1] + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, c: str, hexadecimal: bool = False) -> str:
        if c.isdigit() and c.isascii():
            return "0123456789"[self.below(10)]
        if "a" <= c <= "z":
            return "abcdef"[self.below(6)] if hexadecimal else chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return "ABCDEF"[self.below(6)] if hexadecimal else chr(65 + self.below(26))
        return c


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate."""
    d = Draw(key, kind, canonical, attempt)
    more = max(0, attempt - ATTEMPTS + 4) // 4  # characters beyond the format
    if kind.startswith(("given", "family")):
        role, script, *gender = kind.split("_")
        parts = (GIVEN[script]["stem"], GIVEN[script]["middle"], GIVEN[script][gender[0]]) if role == "given" else FAMILY[script]
        return "-".join("".join(p[d.below(len(p))] for p in parts) for _ in range(1 + attempt // 16)).casefold()
    if kind == "email":
        head, _, top = canonical.rpartition(".")
        return "".join(d.like(c) for c in head + "a" * more) + "." + top
    if kind == "ip":
        low, high = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 255}
        if more:
            return ".".join(str(d.below(256)) for _ in range(4 + (more - 1) // 16))
        return ".".join(str(low[len(x)] + d.below(high[len(x)] - low[len(x)] + 1)) for x in canonical.split("."))
    if kind == "card":
        body = canonical[0] + "".join(d.like(c) for c in canonical[1:-1] + "0" * more)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone" and canonical[0] == "+":
        code = 1 + _code(canonical[1:])
        return canonical[:code] + "".join("23456789"[d.below(8)] if i == 0 else d.like(c) for i, c in enumerate(canonical[code:] + "0" * more))
    if kind in ("phone", "ssn"):
        return "".join("23456789"[d.below(8)] if i == 0 and c not in "01" else d.like(c) for i, c in enumerate(canonical + "0" * more))
    if canonical.startswith("AKIA") and len(canonical) == 20:
        return "AKIA" + "".join(d.like(c) for c in canonical[4:])
    plain = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical))
    return "".join(d.like(c, plain) for c in canonical + "0" * more)


def render(mention: str, kind: str, canonical: str, new: str) -> str:
    """``new`` in the format of the mention."""
    if kind in ("card", "phone", "ssn"):
        canonical, new = canonical.lstrip("+"), new.lstrip("+")
        skip, own = len(re.sub(r"\D", "", mention)) - len(canonical), iter(new)
        out = []
        for c in mention:
            if c.isdigit():
                skip -= 1
                c = c if skip >= 0 else next(own)
            out.append(c)
        return "".join([*out, *own])
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    if kind == "email":
        dot = mention.rindex(".")
        like = mention[:dot] + "a" * (len(new) - len(mention)) + mention[dot:]
        return "".join(n.upper() if m.isupper() else n for m, n in zip(like, new, strict=True))
    return new


def replace(text: str | None, key: bytes, known: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, int]:
    """The text with surrogates, and the number of mentions replaced.  ``known``: the type and attempt of entities that have another than their own and 0."""
    if not text:
        return text, 0
    found, out, at = find(text), [], 0
    for s, e, kind, canonical in found:
        own, attempt = known.get((kind, canonical), (kind, 0))
        out += [text[at:s], render(text[s:e], own, canonical, surrogate(key, own, canonical, attempt))]
        at = e
    return ("".join([*out, text[at:]]), len(found)) if found else (text, 0)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, canonical) of all texts."""

    def run(it):
        for batch in (some for whole in it for some in slices(whole, 0)):
            found = {(k, c) for t in batch.column(0).to_pylist() if t for _, _, k, c in find(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "canonical"])

    return arrow_map(docs.select(F.col(text).alias("text")), run, "kind string, canonical string").distinct()


def genders(found: DataFrame) -> DataFrame:
    """(kind, canonical, own): all entities, given names by the one gender that their titles name over all texts, else as neutral."""
    given = F.col("kind").startswith("given")
    stem, sex = F.regexp_replace("kind", "_[fmn]$", ""), F.substring("kind", -1, 1)
    one = found.filter(given).groupBy(stem.alias("stem"), "canonical").agg(F.array_sort(F.collect_set(F.when(sex != "n", sex))).alias("sexes"))  # two at most
    own = F.concat("stem", F.lit("_"), F.when(F.size("sexes") == 1, F.element_at("sexes", 1)).otherwise("n"))
    named = found.filter(given).withColumn("stem", stem).join(one, ["stem", "canonical"]).select("kind", "canonical", own.alias("own"))
    return named.unionByName(found.filter(~given).withColumn("own", F.col("kind")))


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, own, attempt) of the entities that are taken as another type, or need an attempt above 0 for distinct surrogates.

    All surrogates are drawn once; after that only who clashes draws again, and is judged against what stands.
    """
    typed = stash(genders(found), "genders")
    entities_ = stash(typed.select(F.col("own").alias("kind"), "canonical").distinct(), "typed")
    now = entities_.withColumn("attempt", F.lit(0))
    real = entities_.select("kind", F.col("canonical").alias("new"), F.lit(True).alias("real"))

    def run(it):
        for batch in it:
            new = [surrogate(key, k, c, a) for k, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

    settled = None
    while True:  # formats grow with the attempt
        drawn = stash(arrow_map(now, run, "kind string, canonical string, attempt int, new string"), "surrogates")
        first = drawn.groupBy("kind", "new").agg(F.min("canonical").alias("first"))
        judged = drawn.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        clash = F.col("real").isNotNull() | (F.col("first") != F.col("canonical"))
        if settled is not None:
            judged = judged.join(settled.select("kind", "new", F.lit(True).alias("had")), ["kind", "new"], "left")
            clash = clash | F.col("had").isNotNull()
        judged = stash(judged.select("kind", "canonical", "attempt", "new", clash.alias("clash")), "judged")
        fine = judged.filter("not clash").drop("clash")
        settled = fine if settled is None else settled.unionByName(fine)
        now = judged.filter("clash").select("kind", "canonical", F.expr("attempt + 1 + attempt div 4").cast("int").alias("attempt"))
        if now.isEmpty():
            tries = settled.filter("attempt > 0").select(F.col("kind").alias("own"), "canonical", "attempt")
            return typed.join(tries, ["own", "canonical"], "left").filter("own <> kind or attempt is not null").select("kind", "canonical", "own", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", most: int = BROADCAST) -> DataFrame:
    """``docs`` as (row, new_text, n_replaced): row has all columns with the text as it was."""
    spark = session_of(docs)
    odd = stash(exceptions(stash(entities(docs, text), "entities"), key), "exceptions")
    rows, place = packed(docs, text)
    schema = T.StructType([rows.schema["row"], T.StructField("new_text", T.StringType()), T.StructField("n_replaced", T.LongType())])
    if odd.count() <= most:
        known = spark.sparkContext.broadcast({(r.kind, r.canonical): (r.own, r.attempt) for r in odd.collect()})

        def run(it):
            for batch in (some for whole in it for some in row_slices(whole, place)):
                got = [replace(t, key, known.value) for t in batch.column(0).field(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["row", "new_text", "n_replaced"])

        return arrow_map(rows, run, schema)

    keyed = stash(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    own_text = F.col(f"row.`{docs.columns[place]}`").alias("text")

    def mentions(it):
        for batch in (some for whole in it for some in slices(whole, 1)):
            got = [(p, k, c) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, c in {(k, c) for _, _, k, c in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), *(pa.array([x[i] for x in got], pa.string()) for i in (1, 2))], ["id", "kind", "canonical"])

    need = arrow_map(keyed.select("id", own_text), mentions, "id long, kind string, canonical string").join(odd, ["kind", "canonical"])
    need = need.groupBy("id").agg(F.collect_list(F.struct("kind", "canonical", "own", "attempt")).alias("odd"))  # at most the mentions of one text

    def run_own(it):
        for batch in (some for whole in it for some in row_slices(whole, place)):
            got = [replace(t, key, {(x["kind"], x["canonical"]): (x["own"], x["attempt"]) for x in o or ()}) for t, o in zip(batch.column(0).field(place).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["row", "new_text", "n_replaced"])

    return arrow_map(keyed.join(need, "id", "left").select("row", "odd"), run_own, schema)
