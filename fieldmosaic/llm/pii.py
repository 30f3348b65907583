"""Personal data and secrets replaced by surrogates.

Detected entities get keyed replacements of the same type and format: digits for
digits, letters of the same case for letters, valid check digits where the original has
them, names of the same script and gender. One original has one surrogate everywhere,
in whatever notation it appears. Proposals come from an HMAC of the original; corpus-wide
checks then redraw every proposal that two originals share or that equals a real entity,
so different originals stay different and no surrogate points at somebody else.

Only distinct originals and the spans of documents travel between tasks besides the
texts themselves; nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import strings
from .frames import arrow_map, batch, id_and_text, table, unused, written
from .registry import query

MOST_ROUNDS = 60
WIDEN = 8  # redraws of a format before it may grow by a character

_DIGIT = re.compile(r"\d")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_AWS = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}")
_ASSIGNED = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([^\s\"',;]{6,})", re.IGNORECASE
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w|[.-]\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|(?<!\d)\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|[.-]\d)|(?<![\w+])\+\d{8,15}(?!\w)"
)
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")

#: Titles before a name, by gender.
_TITLES = {
    "m": ("Mr", "Mister", "Herr", "Señor", "Monsieur", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа"),
}
_GENDER = {title: gender for gender, titles in _TITLES.items() for title in titles}
_SCRIPTS = {
    "latin": ("A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"),
    "cyrillic": ("А-ЯЁ", "а-яё"),
    "greek": ("Α-Ω", "α-ωάέήίόύώς"),
}
# with inner capitals (McDonald), after an apostrophe (O'Brien), hyphenated
_PARTS = [rf"(?:[{up}]['’])?(?:[{up}][{low}]+)+" for up, low in _SCRIPTS.values()]
_WORD = "(?:" + "|".join(f"{part}(?:-{part})*" for part in _PARTS) + ")"
_INITIALS = "(?:[" + "".join(up for up, _ in _SCRIPTS.values()) + r"]\. ?)*"
_RUN = re.compile(r"\w+")
_NAME = re.compile(rf"(?<!\w)({'|'.join(_GENDER)})\.? (?:({_WORD}) )?({_INITIALS})({_WORD})(?!\w)")
#: Syllables of surrogate names, and their endings by gender ("" for a family name).
_SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "el", "fa", "ga", "hi", "jo", "ka", "la", "le", "li", "ma", "me", "mi", "na", "ni", "ra", "ro", "sa", "ta", "ti", "va"),
    "cyrillic": ("ба", "ве", "га", "да", "же", "за", "ки", "ла", "ле", "ма", "ми", "на", "ра", "ро", "са", "та", "ти", "фе"),
    "greek": ("βα", "γα", "δη", "θε", "κα", "λα", "λε", "μα", "νι", "πα", "ρα", "ρο", "σο", "τα", "φι"),
}
_ENDINGS = {
    "latin": {"f": ("na", "lia", "ra"), "m": ("ron", "rik", "mus"), "": ("ner", "sen", "dal")},
    "cyrillic": {"f": ("на", "лия"), "m": ("мир", "тон"), "": ("енко", "ский")},
    "greek": {"f": ("νη", "λια"), "m": ("νος", "ρης"), "": ("ίδης", "άκης")},
}


@dataclass(frozen=True)
class Span:
    begin: int
    end: int
    kind: str
    original: str  # the entity whatever its notation
    surface: str


def luhn(digits: str) -> int:
    """Check sum of a card number; 0 if valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _script(name: str) -> str:
    return next((s for s, (up, low) in _SCRIPTS.items() if re.match(f"[{up}{low}]", name)), "latin")


def _digits(surface: str) -> str:
    return "".join(c for c in surface if c.isdigit())


def detect(text: str) -> list[Span]:
    """Entities of a text, ascending and without overlaps; the first named kind wins."""
    found: list[Span] = []

    def add(kind: str, match: re.Match, original: str, group: int = 0) -> None:
        found.append(Span(match.start(group), match.end(group), kind, original, match.group(group)))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", m, m.group().lower())
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            add("secret", m, m.group(1), 1)
    if "AKIA" in text:
        for m in _AWS.finditer(text):
            add("secret", m, m.group())
    if "_" in text or "-" in text:
        for m in _TOKEN.finditer(text):
            add("secret", m, m.group())
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            plain = m.group().replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_rest(plain) == 1:
                add("iban", m, plain)
        for m in _CARD.finditer(text):
            add("card", m, _digits(m.group()))
        for m in _SSN.finditer(text):
            add("ssn", m, _digits(m.group()))
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m.group().split(".")):
                add("ip", m, m.group())
        for m in _PHONE.finditer(text):
            if 7 <= len(_digits(m.group())) <= 15:
                add("phone", m, _digits(m.group()))
    names: dict[str, tuple[str, str]] = {}
    for m in _NAME.finditer(text):
        given, family = m.group(2), m.group(4)
        if given:
            names.setdefault(given, (f"given:{_GENDER[m.group(1)]}:{_script(given)}", given.lower()))
            found.append(Span(m.start(2), m.end(2), *names[given], given))
        names.setdefault(family, (f"family::{_script(family)}", family.lower()))
        found.append(Span(m.start(3), m.end(4), *names[family], text[m.start(3) : m.end(4)]))
    # a name found once is the same name wherever else the text has it
    found.extend(Span(begin, end, *names[name], name) for begin, end, name in mentions(text, names))
    taken, kept = bytearray(len(text) if found else 0), []
    for span in found:
        if taken.find(1, span.begin, span.end) < 0:
            taken[span.begin : span.end] = b"\1" * (span.end - span.begin)
            kept.append(span)
    return sorted(kept, key=lambda s: s.begin)


def mentions(text: str, names: Iterable[str]) -> Iterator[tuple[int, int, str]]:
    """Where whole words of a text are one of the names, the longest name first, without overlaps.

    One pass over the words: each looks up only the lengths of names that begin with it.
    """
    lengths: dict[str, set[int]] = {}
    for name in names:
        lengths.setdefault(_RUN.match(name).group(), set()).add(len(name))
    longest_first = {run: sorted(sizes, reverse=True) for run, sizes in lengths.items()}
    known, free = set(names), 0
    for m in _RUN.finditer(text) if known else ():
        begin = m.start()
        for size in longest_first.get(m.group(), ()) if begin >= free else ():
            end = begin + size
            if end <= len(text) and text[begin:end] in known and not _RUN.match(text, end):
                yield begin, end, text[begin:end]
                free = end
                break


class Draw:
    """Keyed pseudo-random choices for one original."""

    def __init__(self, key: bytes, *parts: str | int):
        self.key, self.name, self.block, self.left = key, "|".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        # 4 bytes a draw: the bias of at most n / 2^32 does not matter here
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.name + b"#" + str(self.block).encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def pick(self, options: str | tuple[str, ...]) -> str:
        return options[self.below(len(options))]


_LOWER, _UPPER, _NUMBERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _alike(text: str, draw: Draw, numbers: str = _NUMBERS, lower: str = _LOWER, upper: str = _UPPER) -> str:
    """A character of the same class for every letter and digit."""
    return "".join(
        draw.pick(numbers) if c in _NUMBERS else draw.pick(lower) if c.islower() else draw.pick(upper) if c.isupper() else c for c in text
    )


def surrogate(kind: str, original: str, key: bytes, attempt: int = 0) -> str:
    """Proposal for an original; other attempts give others."""
    draw, wider = Draw(key, kind, original, attempt), attempt // WIDEN
    if kind == "email":
        local, _, domain = original.rpartition("@")
        head, _, top = domain.rpartition(".")
        # one domain keeps one surrogate domain
        return f"{_alike(local + 'x' * wider, draw)}@{_alike(head, Draw(key, 'domain', domain))}.{top}"
    if kind == "secret":
        opening = re.match(r"AKIA|gh[po]_|sk-|xox[abp]-|", original).group()
        rest = original[len(opening) :] + "0" * wider
        if re.fullmatch(r"[0-9a-f]+", rest):
            return opening + "".join(draw.pick("0123456789abcdef") for _ in rest)
        return opening + _alike(rest, draw)
    if kind == "ip":
        parts = []
        for part in original.split("."):
            low, high = (0, 255) if wider else {1: (0, 9), 2: (10, 99)}.get(len(part), (100, 255))
            parts.append(str(low + draw.below(high - low + 1)))
        return ".".join(parts)
    if kind == "iban":
        body = _alike(original[4:], draw) + "0" * wider
        return f"{original[:2]}{98 - _iban_rest(original[:2] + '00' + body):02d}{body}"
    if kind in ("card", "ssn", "phone"):
        # the first digit tells issuer or country and stays
        out = original[0] + "".join(draw.pick(_NUMBERS) for _ in original[1:]) + "".join(draw.pick(_NUMBERS) for _ in range(wider))
        if kind == "card" and luhn(original) == 0:
            out = out[:-1] + "0"
            out = out[:-1] + str((10 - luhn(out)) % 10)
        return out
    part, gender, script = kind.split(":")
    middle = "".join(draw.pick(_SYLLABLES[script]) for _ in range(2 + wider))
    return middle + draw.pick(_ENDINGS[script][gender if part == "given" else ""])


def render(kind: str, surface: str, value: str) -> str:
    """A surrogate in the notation of the surface it replaces."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(value)
        out = "".join(next(left, "") if c.isalnum() else c for c in surface)
        return out + "".join(left)
    if kind == "email":
        return value.upper() if surface.isupper() else value.capitalize() if surface[:1].isupper() else value
    if kind.partition(":")[0] in ("given", "family"):
        # initials before a name become letters of its surrogate
        opening = re.match(_INITIALS, surface).group()
        return "".join(value[ord(c) % len(value)].upper() if c.isalpha() else c for c in opening) + value.capitalize()
    return value


_SPANS = "doc_id long, row_key long, begin int, end int, kind string, original string, surface string"


def entities(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Every detected span with its document's id; ``row_key`` is a hash of id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {"doc_id": [], "row_key": [], "begin": [], "end": [], "kind": [], "original": [], "surface": []}
            for doc_id, key, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strings(rows.column(1))):
                for s in detect(text):
                    for name, value in zip(out, (doc_id, key, s.begin, s.end, s.kind, s.original, s.surface)):
                        out[name].append(value)
            yield batch(out, doc_id=pa.int64(), row_key=pa.int64(), begin=pa.int32(), end=pa.int32(), kind=pa.string(), original=pa.string(), surface=pa.string())

    key = F.xxhash64(F.col(id_column), F.col(text_column)).alias("row_key")
    return arrow_map(id_and_text(docs, key, id_column=id_column, text_column=text_column), work, _SPANS).distinct()


def _mapped(df: DataFrame, make: Callable[..., str], inputs: list[str], name: str) -> DataFrame:
    """One more text column, made row by row from others."""
    kept = df.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = [make(*values) for values in zip(*(rows.column(c).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, pa.string())], [*rows.schema.names, name])

    return arrow_map(df, work, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{name} string"]))


def _group(kind: Column) -> Column:
    """Kinds whose originals share one space of surrogates: a name is the same in every role."""
    return F.when(kind.startswith("given:") | kind.startswith("family:"), "name").otherwise(kind)


def surrogates(originals: DataFrame, key: bytes) -> DataFrame:
    """``(kind, original, surrogate)``: one surrogate each, all different, none an original.

    A name that appears in several roles has one surrogate and is listed once, as kind
    ``name``; its form follows a given name before a family name.
    """
    role = F.struct(F.col("kind").startswith("family:"), F.col("kind").alias("kind"))
    originals = written(
        originals.groupBy(_group(F.col("kind")).alias("group"), "original").agg(F.min(role)["kind"].alias("kind")), "originals"
    )
    settled: list[DataFrame] = []
    pending = originals
    for attempt in range(MOST_ROUNDS):
        proposed = written(
            _mapped(pending, lambda kind, original, attempt=attempt: surrogate(kind, original, key, attempt), ["kind", "original"], "surrogate"),
            "surrogates",
        )
        taken = originals.select("group", F.col("original").alias("surrogate"))
        for done in settled:
            taken = taken.unionByName(done.select("group", "surrogate"))
        first = proposed.groupBy("group", "surrogate").agg(F.min("original").alias("original"))
        good = proposed.join(first, ["group", "surrogate", "original"], "left_semi").join(taken, ["group", "surrogate"], "left_anti")
        bad = written(proposed.join(good, ["group", "original"], "left_anti").select("group", "original", "kind"), "redrawn")
        clash = not bad.isEmpty()
        settled.append(written(good.select("group", "original", "surrogate"), "settled") if clash else proposed.select("group", "original", "surrogate"))
        if not clash:
            break
        pending = bad
    else:
        raise RuntimeError(f"surrogates still clash after {MOST_ROUNDS} rounds")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("group", "kind")


def replace_spans(text: str, spans: list[dict]) -> str:
    """A text with ascending spans replaced, in one pass."""
    parts, at = [], 0
    for span in spans:
        parts += (text[at : span["begin"]], span["put"])
        at = span["end"]
    return "".join([*parts, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, text_column: str = "text", id_column: str = "doc_id", count: str | None = None) -> DataFrame:
    """The input rows with entities replaced, and ``count``, the number of replacements.

    All other columns stay as they are. Null and empty texts stay; repeated rows are
    all returned. A table without entities, or without rows, is returned unchanged.
    The cost of a text is linear in its length and its entities.
    """
    spans = written(entities(docs, text_column, id_column), "spans")
    made = surrogates(spans, key).withColumnRenamed("kind", "group")
    chosen = spans.withColumn("group", _group(F.col("kind"))).join(made, ["group", "original"])
    rendered = _mapped(
        chosen.select("doc_id", "row_key", "begin", "end", "kind", "surface", "surrogate"), render, ["kind", "surface", "surrogate"], "put"
    )
    row, doc, mine, put = (unused(docs, name) for name in ("__row", "__doc", "__key", "__spans"))
    per_row = rendered.groupBy(F.col("row_key").alias(row), F.col("doc_id").alias(doc)).agg(
        F.array_sort(F.collect_list(F.struct("begin", "end", "put"))).alias(put)
    )

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array(
            [t.as_py() if not s.is_valid else replace_spans(t.as_py(), s.as_py()) for t, s in zip(texts, lists)], pa.string()
        )

    text = F.col(text_column)
    joined = docs.withColumn(mine, F.xxhash64(F.col(id_column), text)).join(
        per_row, (F.col(mine) == F.col(row)) & F.col(id_column).cast("long").eqNullSafe(F.col(doc)), "left"
    )
    columns = [replaced(text, F.col(put)).alias(c) if c == text_column else F.col(c) for c in docs.columns]
    counted = F.when(F.col(put).isNotNull(), F.size(put)).otherwise(0).cast("long")
    return joined.select(*columns, *([counted.alias(count)] if count else []))


#: The key of the registered query and the pipeline; a deployment passes its own.
DEMO_KEY = b"public example key"


@query("op9_pii_surrogates")
def op9_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates in place of its entities."""
    return pseudonymise(table(spark, folder, "documents"), DEMO_KEY, count="n_entities").select("doc_id", "text", "n_entities")
