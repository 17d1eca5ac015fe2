"""Personal data replaced by keyed surrogates.

Entities are found in each text by type.  The distinct entities of the whole input get
surrogates from a keyed hash: digits for digits and letters for letters of the same script
and case, names of the same gender, numbers that keep their separators, length and check
digit.  A collision check makes them distinct as they are read: where two entities of one type
have the same surrogate (of persons: the same surname, which may stand alone), or a surrogate is
itself an entity of the input, a later one is drawn anew until all differ; where a class is used up, the
surrogate gets longer, so this ends.  Every mention of an entity, however it is written, gets the
same surrogate, in the mention's own format, so coreference stays.

Texts are packed in stored blocks, so no document id decides where they go; shuffled are the
distinct entities, the (block, entity) pairs and the compressed blocks.

Defined cases: a null text stays null; texts without entities stay as they are; extra
columns pass through; repeated rows are treated alike; a long text is read whole, in its task's memory; an empty table gives an empty one; document ids may be null or repeated;
a person whose mentions differ in gender takes the one that sorts last (m, f, none).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import opened, packed
from .tables import stored

#: For tests and the registered queries; whoever knows the key can try surrogates out, so real runs bring their own.
TEST_KEY = b"not a secret"
#: Draws of a fixed length; each further one is a sign longer.
DRAWS = 4

_NUMBERS = re.compile(r"\d[\d ().\-]{5,}")
_NUMBER = re.compile(
    r"(?P<IP>\d{1,3}(?:\.\d{1,3}){3}(?![\d]))"
    r"|(?P<SSN>\d{3}-\d{2}-\d{4}(?!\d))"
    r"|(?P<CARD>\d{13,19}(?!\d)|\d{4}([ \-])\d{4}\4\d{4}\4\d{1,7}(?!\d))"
    r"|(?P<PHONE>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .\-]?\d{4}(?!\d)|\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d))"
)
_LOCAL = re.compile(r"[\w.%+\-]")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}")
_ASSIGNED = re.compile(r"""[=:]\s*["']?([A-Za-z0-9_\-+/=.]{12,})""")
_NAMED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|bearer|credentials?)$""")
_ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bap]-[A-Za-z0-9\-]{10,}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Titles by gender, and names by script and gender.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Господин", "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Srta Госпожа", "": "Dr Prof Доктор"}
NAMES = {
    ("LATIN", "m"): "Adam Boris Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ralf Simon Theo Victor",
    ("LATIN", "f"): "Anna Berta Clara Diana Emma Frida Greta Helga Irene Julia Karla Laura Maria Nadia Olga Paula Rosa Sofia Tina Vera",
    ("CYRILLIC", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Степан",
    ("CYRILLIC", "f"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья",
}
SURNAMES = {
    "LATIN": "Abel Brandt Colson Drake Ellis Foster Grant Harmon Iversen Jansen Keller Lindt Morris Norton Olsen Palmer Quint Ramsey Sutter Thorne Ulrich Vance Weston Young Zeller",
    "CYRILLIC": "Андреенко Борисенко Викторенко Гордеенко Демченко Ермоленко Захаренко Иваненко Кириленко Лысенко Марченко Назаренко",
}
_TITLE = {t: g for g, words in TITLES.items() for t in words.split()}
_GIVEN = {n: g for (_, g), names in NAMES.items() for n in names.split()}
_PERSON = re.compile(r"(?:" + "|".join(sorted(_TITLE, key=len, reverse=True)) + r")\.? ([^\W\d_a-zà-ÿа-я][^\W\d_]+(?:[ \-][^\W\d_a-zà-ÿа-я][^\W\d_]+){0,2})")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    canonical: str
    gender: str = ""  # of persons, where something says so


def _is_iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entities(text: str) -> list[Entity]:
    """Entities in order of place, without overlaps; earlier and then longer ones go first."""
    found: list[Entity] = []
    if "@" in text:
        at, last = text.find("@"), 0
        while at >= 0:
            first = at
            while first > last and _LOCAL.match(text, first - 1):
                first -= 1
            right = _DOMAIN.match(text, at + 1)
            if first < at and right:
                found.append(Entity(first, right.end(), "EMAIL", text[first : right.end()].lower()))
            at, last = text.find("@", at + 1), at + 1
    for run in _NUMBERS.finditer(text):
        first = run.start()
        while first > 0 and text[first - 1] in "+(" and run.start() - first < 2:
            first -= 1
        for m in _NUMBER.finditer(text, first, run.end()):
            before = text[m.start() - 1] if m.start() else " "
            after = text[m.end()] if m.end() < len(text) else " "
            kind = m.lastgroup or "CARD"
            if before.isalnum() or before in "_." or after.isalnum() or after == "_":
                continue
            if kind == "IP" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            found.append(Entity(m.start(), m.end(), kind, m[0] if kind == "IP" else re.sub(r"\D", "", m[0])))
    for m in _ASSIGNED.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        end -= end > 0 and text[end - 1] in "\"'"
        if _NAMED.search(text[max(0, end - 16) : end]):  # no name is longer
            found.append(Entity(m.start(1), m.end(1), "SECRET", m[1]))
    if "AKIA" in text or "gh" in text or "sk-" in text or "xox" in text:
        found += [Entity(m.start(), m.end(), "SECRET", m[0]) for m in _ISSUED.finditer(text) if not (m.start() and text[m.start() - 1].isalnum())]
    for m in _IBAN.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()) and _is_iban(m[0]):
            found.append(Entity(m.start(), m.end(), "IBAN", m[0].replace(" ", "")))
    people: dict[str, str] = {}
    for m in _PERSON.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()):
            title = m[0].split(" ")[0].rstrip(".")
            gender = _TITLE[title] or _GIVEN.get(m[1].split(" ")[0], "")
            people[m[1]] = gender
    if people:
        surnames = {n.split(" ")[-1]: n for n in sorted(people, key=len)}
        for name in sorted({*people, *surnames}, key=len, reverse=True):
            full = name if name in people and " " in name else surnames.get(name, name)
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
                found.append(Entity(m.start(), m.end(), "PERSON", full, people.get(full, "")))
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


# ------------------------------------------------------------ surrogates


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.n, self.left = key, "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.what + b"\0" + str(self.n).encode(), hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _like(c: str, s: _Stream) -> str:
    """A character of the same class, case and script."""
    if c.isdigit():
        return str(s.below(10))
    if "a" <= c <= "z":
        return chr(97 + s.below(26))
    if "A" <= c <= "Z":
        return chr(65 + s.below(26))
    if c.isalpha():
        name = unicodedata.name(c, "").split(" ")[0]
        page = [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if unicodedata.name(x, "").startswith(name) and unicodedata.category(x) == unicodedata.category(c)]
        return page[s.below(len(page))] if page else c
    return c


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The surrogate's canonical form."""
    s = _Stream(key, kind, canonical, attempt)
    more = max(0, attempt - DRAWS)
    if kind == "IP":
        if more:  # all addresses of that form are used up: one of the prefix that is kept for examples
            return "2001:db8" + "".join(f":{s.below(65536):x}" for _ in range(6))
        return ".".join(str(1 + s.below(223) if i == 0 else s.below(256)) for i in range(4))
    if kind == "EMAIL":
        local, domain = canonical.split("@", 1)
        label = "".join(_like(c, s) for c in domain.split(".")[0]).strip("-") or "x"
        return "".join(_like(c, s) for c in local + "a" * more) + f"@{label}.example." + ("com", "net", "org")[s.below(3)]  # nobody can own these
    if kind in ("CARD", "PHONE", "SSN"):
        out = "".join(str(s.below(10)) for _ in canonical + "0" * more)
        if kind == "PHONE":
            out = canonical[0] + out[1:]  # the country's first digit
        if kind == "CARD":
            out = next(x for x in (out[:-1] + str((int(out[-1]) + d) % 10) for d in range(10)) if _luhn(x) == _luhn(canonical))
        return out
    if kind == "IBAN":
        body = "".join(_like(c, s) for c in canonical[4:] + "0" * more)
        return f"{canonical[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + canonical[:2] + '00')) % 97:02d}{body}"
    if kind == "PERSON":
        script = "CYRILLIC" if unicodedata.name(canonical[0], "").startswith("CYRILLIC") else "LATIN" if unicodedata.name(canonical[0], "").startswith("LATIN") else ""
        if not script:
            return "".join(_like(c, s) for c in canonical + canonical[-1] * more)
        given, last = NAMES[script, gender or "mf"[s.below(2)]].split(), SURNAMES[script].split()
        new = [given[s.below(len(given))] for _ in canonical.split(" ")[:-1]]
        # A pool is soon used up, so later attempts join surnames.
        return " ".join([*new, "-".join(last[s.below(len(last))] for _ in range(1 + attempt))])
    if re.fullmatch(r"[0-9a-f]+", canonical):
        return "".join("0123456789abcdef"[s.below(16)] for _ in canonical + "0" * more)
    return "".join(_like(c, s) for c in canonical + "a" * more)


def visible(kind: str, canonical: str) -> str:
    """The least that a text shows of an entity: of a person it may be the surname."""
    return canonical.split(" ")[-1] if kind == "PERSON" else canonical


def written(e: Entity, mention: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if e.kind in ("CARD", "PHONE", "SSN", "IBAN"):
        signs = iter(new)
        return "".join(next(signs) if c.isalnum() else c for c in mention) + "".join(signs)
    if e.kind == "PERSON":
        return new if " " in mention or " " not in e.canonical else new.split(" ")[-1]
    return new


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical and surrogate for distinct entities (kind, canonical, gender), all different as they are read within a kind."""

    @F.pandas_udf("surrogate string, seen string")
    def draw(kind, canonical, gender, attempt):
        import pandas as pd

        new = [surrogate(k, c, key, int(a), g) for k, c, g, a in zip(kind, canonical, gender, attempt)]
        return pd.DataFrame({"surrogate": new, "seen": [visible(k, x) for k, x in zip(kind, new)]})

    @F.pandas_udf("string")
    def shown(kind, canonical):
        import pandas as pd

        return pd.Series([visible(k, c) for k, c in zip(kind, canonical)])

    real = stored(found.select("kind", shown("kind", "canonical").alias("seen")).distinct())

    def drawn_anew(rows: DataFrame) -> DataFrame:
        return rows.withColumn("d", draw("kind", "canonical", "gender", "attempt")).select("kind", "canonical", "gender", "attempt", "d.surrogate", "d.seen")

    drawn = stored(drawn_anew(found.select("kind", "canonical", "gender", F.lit(0).alias("attempt"))))
    while True:
        first = drawn.groupBy("kind", "seen").agg(F.min(F.struct("attempt", "canonical")).alias("f"), F.count("*").alias("n"))
        twice = drawn.join(first.filter("n > 1").select("kind", "seen", F.col("f.canonical").alias("keeps")), ["kind", "seen"]).filter("canonical <> keeps")
        taken = drawn.join(real, ["kind", "seen"], "left_semi")
        again = stored(twice.select("kind", "canonical").union(taken.select("kind", "canonical")).distinct())
        if again.isEmpty():
            return drawn.select("kind", "canonical", "surrogate")
        anew = drawn.join(again, ["kind", "canonical"], "left_semi").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))
        drawn = stored(drawn.join(again, ["kind", "canonical"], "left_anti").union(drawn_anew(anew)))


def replace_private(docs: DataFrame, key: bytes, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in their texts, and, unless count is None, the number of mentions replaced (that column is replaced)."""
    names = [c for c in docs.columns if c != count]
    at = names.index(text)
    schema = T.StructType([*(docs.schema[c] for c in names), *([T.StructField(count, T.LongType())] if count else [])])
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = packed(docs.select(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(names)]), lambda batch: batch, size)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0), batch.column(1)):
                seen = {(e.kind, e.canonical, e.gender) for part in opened([body]) for t in part.column(at) for e in entities(t.as_py() or "")}
                kinds, canonical, gender = zip(*sorted(seen)) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(seen), pa.int64()), *(pa.array(x, pa.string()) for x in (kinds, canonical, gender))], names=["block", "kind", "canonical", "gender"])

    pairs = stored(blocks.mapInArrow(find, "block long, kind string, canonical string, gender string"))
    table = assigned(pairs.groupBy("kind", "canonical").agg(F.max("gender").alias("gender")), key)
    asked = pairs.select("block", "kind", "canonical").distinct().join(table, ["kind", "canonical"])

    def put(texts: pa.Table, new: pa.Table) -> pa.Table:
        table = dict(zip(zip(new["kind"].to_pylist(), new["canonical"].to_pylist()), new["surrogate"].to_pylist()))
        out = []
        for part in opened(texts["body"]):
            changed, counts = [], []
            for t in part.column(at):
                t, n = t.as_py(), 0
                if t and table:
                    done, last = [], 0
                    for e in entities(t):
                        done += [t[last : e.start], written(e, t[e.start : e.end], table[e.kind, e.canonical])]
                        last = e.end
                        n += 1
                    t = "".join([*done, t[last:]])
                changed.append(t)
                counts.append(n)
            columns = list(part.columns)
            columns[at] = pa.array(changed, pa.string())
            out.append(pa.RecordBatch.from_arrays([*columns, *([pa.array(counts, pa.int64())] if count else [])], names=schema.names))
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(put, schema)


def without_private(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates, and the columns of docs."""
    out = replace_private(docs, key, count=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_private(docs, TEST_KEY)
