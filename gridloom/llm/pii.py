"""Personal data: detection, and surrogates of the same type in their place.

Each distinct entity (type and normalised value) of the corpus gets one surrogate, so what was one person, card or address in many
places is one after. A surrogate follows from the key, the type, the value and the number of earlier attempts. It keeps the
format: digits stay digits, letters keep case and script, separators, lengths, country codes, top-level domains and
check digits stay as they are; names keep gender, script and number of parts. A surrogate that another entity has too, or
that is itself an entity of the corpus, is refused and drawn again, so distinct entities stay distinct. Values of which no sign can be
drawn (``********``) get a keyed token. A format that has too few values for its entities is left after ``SAME_FORMAT`` attempts:
each further one makes the surrogate longer by a sign (of addresses of private networks, one in any network).

Names are told apart by their letters and by gender: "Mr ADAMS", "Mr Adams" and, where the corpus has that name with one gender only, "Dr
Adams" are one person; "Mr Adams" and "Mrs Adams" are two. Surrogates are compared as they are read, without title and case.

Types: email, ip, card, ssn, iban, phone, secret, name.

Defined results: null and empty texts have no entities and stay as they are; rows with the same id stay separate rows; of
overlapping finds the first, then the longest, counts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, sliced, trimmed, written

BATCH_BYTES = 3_000_000
SAME_FORMAT = 10

#: Given names by gender, family names, titles by gender.
GIVEN = {
    "f": ["Anna", "Maria", "Laura", "Julia", "Sophie", "Emma", "Clara", "Elena", "Lucia", "Marie", "Sarah", "Mary", "Linda", "Susan", "Karen", "Nancy", "Alice", "Helen", "Emily", "Olivia"],
    "m": ["Peter", "Thomas", "Daniel", "Martin", "Lucas", "Paul", "Simon", "Jorge", "Carlos", "Pierre", "James", "John", "Robert", "David", "William", "Joseph", "Mark", "George", "Henry", "Oliver"],
}
FAMILY = ["Smith", "Jones", "Brown", "Miller", "Davis", "Wilson", "Moore", "Taylor", "Schmidt", "Weber", "Fischer", "Wagner", "Martin", "Bernard", "Dubois", "Moreau", "Garcia", "Lopez", "Perez", "Torres"]
TITLES = {"Mr": "m", "Herr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Mlle": "f", "Sr": "m", "Sra": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
SYLLABLES = ["ba", "den", "fel", "gor", "hal", "ki", "lan", "mar", "nor", "pel", "ros", "sten", "tor", "vik", "wen", "zan"]

LOCAL = re.compile(r"[\w.+-]")
DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
NUMBERS = re.compile(r"(?:\+|\()?\d(?:[\d().\-]| (?=[\d(]))*\d")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
RANDOM = re.compile(r"\b[0-9A-Za-z_\-]{32,}\b")
ASSIGNED = re.compile(r"\b(\w+)[\"']?\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']")
SECRET_NAMES = re.compile(r"(?i)token|secret|passw|pwd|api_?key|credential|private_?key")
TITLED = re.compile(r"\b(Mrs?|Ms|Miss|Herr|Frau|Mme|Mlle|Sra?|Señora?|Dr|Prof)\.? ([^\W\d_a-zß-ÿ][^\W\d_]+(?: [^\W\d_a-zß-ÿ][^\W\d_]+)?)")
CUED = re.compile(r"(?:\b[Mm]y name is|\bI am called|\b[Ii]ch heiße|\b[Mm]ein Name ist|\b[Jj]e m'appelle|\b[Mm]e llamo|\b[Ss]igned by) ([^\W\d_a-zß-ÿ][^\W\d_]+(?: [^\W\d_a-zß-ÿ][^\W\d_]+)?)")
NAMED = re.compile(r"\b([A-Z][a-z]+) ([A-Z][a-z]+)\b")
SHAPES = (
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")),
    ("card", re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?")),
    ("phone", re.compile(r"\+\d[\d ().\-]{6,}\d|\(\d{2,4}\) ?\d[\d .\-]{4,}\d|\d{3}[-. ]\d{3}[-. ]\d{4}|0\d{2,4}[-/ ]\d{5,8}")),
)
_gender = {name: g for g, names in GIVEN.items() for name in names}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The places of addresses. The search starts from each ``@``, so a long run of letters is not gone through again and again."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def person(gender: str, said: str) -> str:
    """The identity of a name: case, blanks and the title it was met with do not tell people apart, but gender does."""
    return f"{gender}:{' '.join(said.casefold().split())}"


def finds(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, normalised value)`` of each entity, in order, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(a, b, "email", text[a:b].lower()) for a, b in emails(text)]
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        said = m[0]
        for kind, shape in SHAPES:
            if shape.fullmatch(said):
                out.append((m.start(), m.end(), kind, said if kind == "ip" else "".join(c for c in said if c.isdigit() or c == "+")))
                break
        else:  # numbers that only stand side by side
            at = m.start()
            for part in re.finditer(r"\S+", said):
                kind = next((k for k, shape in SHAPES if len(part[0]) >= 7 and shape.fullmatch(part[0].rstrip(".-("))), None)
                if kind:
                    value = part[0].rstrip(".-(")
                    out.append((at + part.start(), at + part.start() + len(value), kind, value if kind == "ip" else "".join(c for c in value if c.isdigit() or c == "+")))
    out += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
    for m in RANDOM.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 4 and any(c.isalpha() for c in m[0]):
            out.append((m.start(), m.end(), "secret", m[0]))
    if '"' in text or "'" in text:
        out += [(m.start(2), m.end(2), "secret", m[2]) for m in ASSIGNED.finditer(text) if SECRET_NAMES.search(m[1])]
    for m in TITLED.finditer(text):
        out.append((m.start(2), m.end(2), "name", person(TITLES[m[1]] or _gender.get(m[2].split(" ")[0], ""), m[2])))
    out += [(m.start(1), m.end(1), "name", person(_gender.get(m[1].split(" ")[0], ""), m[1])) for m in CUED.finditer(text)]
    out += [(m.start(), m.end(), "name", person(_gender[m[1]], m[0])) for m in NAMED.finditer(text) if m[1] in _gender]
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, free = [], 0
    for x in out:
        if x[0] >= free:
            kept.append(x)
            free = x[1]
    return kept


class Stream:
    """Numbers that follow from the key and the entity."""

    def __init__(self, key: bytes, *what: object):
        self.state, self.n, self.left = hashlib.blake2b(repr(what).encode(), key=key, digest_size=32).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.n.to_bytes(8, "little"), key=self.state).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return value % n


#: The first and last letter of the scripts whose letters stand in for each other, by case.
RANGES = [("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("一", "龥"), ("ぁ", "ん"), ("ァ", "ン"), ("가", "힣"), ("א", "ת"), ("ا", "ي"), ("à", "ö"), ("À", "Ö")]


@cache
def alike(c: str) -> str:
    """The signs that stand in for a digit of another script than 0-9 or a letter outside RANGES: its script's digits, or the letters of
    its script and kind in its 128 code points; of any other sign only itself."""
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + k) for k in range(10))
    if kind[0] != "L":
        return c
    script = lambda x: unicodedata.name(x, "").split(" ")[0].split("-")[0]
    first = ord(c) & ~0x7F
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and script(x) == script(c) and len(x.lower()) == 1)


def reshaped(value: str, draw: Stream, letters: str | None = None) -> str:
    """Each digit for a digit, each letter for one of its script and case."""
    out = []
    for c in value:
        if "0" <= c <= "9":
            out.append(str(draw.below(10)))
        elif letters and c in letters:
            out.append(letters[draw.below(len(letters))])
        else:
            low, high = next(((a, b) for a, b in RANGES if a <= c <= b), (c, c))
            among = alike(c) if low == high else ""
            out.append(chr(ord(low) + draw.below(ord(high) - ord(low) + 1)) if low != high else among[draw.below(len(among))] if len(among) > 1 else c)
    return "".join(out)


def token(draw: Stream, length: int) -> str:
    return "".join("abcdefghijklmnopqrstuvwxyz0123456789"[draw.below(36)] for _ in range(length))


def fixed(value: str) -> bool:
    """Nothing in the value can be drawn anew."""
    return not any(any(a <= c <= b for a, b in [("0", "9"), *RANGES]) or len(alike(c)) > 1 for c in value)


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The normalised surrogate of a normalised value."""
    draw = Stream(key, kind, value, attempt)
    longer = max(0, attempt - SAME_FORMAT)
    digits = lambda: reshaped("0" * longer, draw)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        *labels, top = domain.split(".")
        first = token(draw, len(local)) if fixed(local) and all(map(fixed, labels)) else reshaped(local, draw)
        return f"{first}{digits()}@{'.'.join(reshaped(x, draw) for x in labels)}.{top}"
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        keep = 0 if longer else 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] else 0
        return ".".join(str(o if k < keep else draw.below(223 if k == 0 else 254) + 1) for k, o in enumerate(octets))
    if kind == "card":
        new = reshaped(value, draw)
        new = new[:-1] + digits() + new[-1]
        if luhn(value) == 0:
            check = (int(new[-1]) - luhn(new)) % 10 if luhn(new[:-1] + "0") else 0
            new = new[:-1] + chr(ord(new[-1]) - int(new[-1]) + check)
        return new
    if kind == "phone":
        kept = 2 if value.startswith("+") else 0
        return value[:kept] + reshaped(value[kept:], draw) + digits()
    if kind == "iban":
        rest = reshaped(value[4:], draw) + digits()
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "secret":
        hexes = next((x for x in ("0123456789abcdef"[10:], "ABCDEF") if all(c.isdigit() or c in x for c in value)), None)
        return (token(draw, len(value)) if fixed(value) else reshaped(value, draw, hexes)) + digits()
    if kind == "name":
        gender, said = value.split(":", 1)
        if not said.isascii() and any(ord(c) > 0x24F for c in said):
            return f"{gender}:{reshaped(said, draw)}{''.join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(longer))}"
        parts = said.split(" ")
        pool = GIVEN[gender] if gender else GIVEN["f"] + GIVEN["m"]
        last = FAMILY[draw.below(len(FAMILY))] if attempt == 0 else "".join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(2 + attempt)).capitalize()
        first = pool[draw.below(len(pool))]
        return f"{gender}:{last if len(parts) == 1 else f'{first} {last}'}"
    return reshaped(value, draw) + digits()


def written_as(kind: str, original: str, new: str) -> str:
    """The normalised surrogate in the format in which the original stood in the text."""
    if kind == "name":
        said = new.split(":", 1)[1]
        return said.upper() if original.isupper() else " ".join(w[:1].upper() + w[1:] for w in said.split(" "))
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for o, c in zip(original, new, strict=False)) if len(original) == len(new) else new
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(new)
        return "".join([*(next(signs) if c.isalnum() or c == "+" else c for c in original), *signs])
    return new


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, found``: the entities of each row as ``array<struct<start, end, type, value>>`` (places in characters)."""
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    entity = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            found = [[{"start": a, "end": b, "type": k, "value": v} for a, b, k, v in finds(t or "")] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, entity)], ["doc_id", "text", "found"])

    return source.mapInArrow(trimmed(run), f"doc_id {kind}, text string, found array<struct<start:int,end:int,type:string,value:string>>")


def shown(kind: Column, value: Column) -> Column:
    """What a reader can tell apart of a value: of a name its letters, without gender and case."""
    return F.when(kind == "name", F.lower(F.regexp_replace(value, "^[^:]*:", ""))).otherwise(value)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``type, value, new`` for the distinct entities ``type, value``: surrogates that differ from each other and from all values, as
    they are shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            new = [surrogate(key, *x) for x in zip(*(part.column(c).to_pylist() for c in ("type", "value", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string())], [*part.schema.names, "new"])

    def drawn(df: DataFrame) -> DataFrame:
        return df.select("type", "value", "attempt").mapInArrow(trimmed(run), "type string, value string, attempt int, new string")

    now = written(drawn(entities.withColumn("attempt", F.lit(0))), "pii-surrogates")
    originals = entities.select("type", shown(F.col("type"), F.col("value")).alias("as"))
    while True:
        seen = now.withColumn("as", shown(F.col("type"), F.col("new")))
        first = seen.groupBy("type", "as").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("type", "as", "first")
        shared = seen.join(first, ["type", "as"]).filter(F.struct("attempt", "value") != F.col("first")).select("type", "value")
        taken = seen.join(originals, ["type", "as"], "left_semi").select("type", "value")
        again = written(shared.union(taken).distinct(), "pii-clashes")
        if again.isEmpty():
            return now.select("type", "value", "new")
        redo = drawn(now.join(again, ["type", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        nxt = written(now.join(again, ["type", "value"], "left_anti").union(redo), "pii-surrogates")
        drop_written(now)
        now = nxt


def one_person(entities: DataFrame) -> DataFrame:
    """``type, value, who``: a name of unknown gender ("Dr Adams") is the same person as that name with a gender ("Mr Adams"), if the
    corpus has it with one gender only; every other entity is itself."""
    name, gender = F.col("type") == "name", F.substring_index("value", ":", 1)
    said = F.when(name, F.regexp_replace("value", "^[^:]*:", ""))
    known = entities.filter(name & (gender != "")).groupBy(said.alias("said")).agg(F.min(gender).alias("gender"), F.max(gender).alias("other")).filter("gender = other").select("said", "gender")
    own = entities.withColumn("said", F.when(gender == "", said))
    return own.join(known, "said", "left").select("type", "value", F.coalesce(F.concat("gender", F.lit(":"), "said"), "value").alias("who"))


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_entities``: each row's text with surrogates in place of its entities."""
    rows = written(detect(df, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pii-found")
    kind = rows.schema["doc_id"].dataType.simpleString()
    some = rows.filter(F.size("found") > 0)
    each = some.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    people = written(one_person(each.select("type", "value").distinct()), "pii-entities")
    given = assign(people.select("type", F.col("who").alias("value")).distinct(), key)
    new = people.join(given.withColumnRenamed("value", "who"), ["type", "who"]).select("type", "value", "new")
    placed = each.join(new, ["type", "value"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "new"))).alias("placed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            out, counts = [], []
            for text, swaps in zip(part.column("text").to_pylist(), part.column("placed").to_pylist(), strict=True):
                pieces, at = [], 0
                for x in swaps:
                    pieces += [text[at : x["start"]], written_as(x["type"], text[x["start"] : x["end"]], x["new"])]
                    at = x["end"]
                out.append("".join([*pieces, text[at:]]))
                counts.append(len(swaps))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_entities"])

    swapped = some.join(placed, "rid").select("doc_id", "text", "placed").mapInArrow(trimmed(run), f"doc_id {kind}, text string, n_entities long")
    return swapped.union(rows.filter(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("long")))
