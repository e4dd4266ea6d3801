"""Surrogates for personal data (operator 1).

Entities found in a text are replaced by keyed surrogates of their own kind:

* digits, letters and hex digits of an e-mail address, phone, card, account, social security or IP
  number or secret are permuted, shape kept, by a keyed Feistel network over the entity's normal
  form. Check digits stay right (or wrong) as they were, country codes and the fictional exchange
  555 stay, domains move under a reserved one. Punctuation, grouping and case are the original's.
* a name keeps its script, length class and case; a given name keeps its gender (by title, or by a
  list of given names; where a mention tells no gender, the one that the name has elsewhere in the corpus, if
  it is only one). Given name and family name are entities of their own, so "Ms Lopez" stays
  the person that "Maria Lopez" is. One line end may stand inside a name. A name that was found
  is replaced wherever its text has it as a word, title or not.

Equal entities have equal surrogates in all documents (coreference). For distinctness the distinct
entities are gathered by an aggregate and checked: a surrogate that two entities share, or that is
itself an entity of the corpus, goes to the entity with the lowest hash only (or to none), and the
others try again with the next attempt number, until none is left (after `MAX_ATTEMPTS` rounds the job fails, no
colliding surrogate is given out). Given and family names of a script draw from one set. A permutation has no two equal
results in the same attempt, so retries are few; a shape whose entities fill a sixteenth of all
strings of it stays with the first attempt, which is free of collisions.

Only entities with a later attempt are looked up when texts are rewritten: as a broadcast table if
it was measured to be small, by a join otherwise.

Cases: null texts stay null, empty texts empty; a null id is kept; repeated rows are rewritten
alike; an empty table gives an empty result; other columns are kept, and an added column
replaces one of the same name.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.tables import bound_batches, column, free_names, map_arrow, remove, written
from strata.sizing import fits, measure

ROUNDS = 8
FULL = 16
MAX_ATTEMPTS = 200

# Titles by gender, and given names by gender.
TITLES = {
    "f": "Mrs Ms Miss Madam Madame Mme Mademoiselle Mlle Frau Señora Sra Señorita Srta Signora Госпожа Κυρία".split(),
    "m": "Mr Mister Sir Monsieur Herr Señor Signor Господин Κύριος".split(),
    "u": "Dr Prof Professor Doctor Doktor Docteur Доктор".split(),
}
GIVEN = {
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Anna Maria Marie Sophie Julie "
        "Camille Claire Isabelle Nathalie Ursula Monika Petra Sabine Carmen Lucia Sofia Elena Laura Marta Pilar Giulia "
        "Анна Мария Ольга Елена Наталья Татьяна Ирина Μαρία Ελένη Κατερίνα"
    ).split(),
    "m": (
        "James Robert John Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Jean Pierre Michel "
        "Philippe Nicolas Hans Klaus Jürgen Wolfgang Stefan Uwe José Juan Carlos Luis Javier Miguel Pedro Giovanni "
        "Иван Сергей Дмитрий Андрей Алексей Михаил Γιώργος Δημήτρης Νίκος"
    ).split(),
}
# Syllables of surrogate names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bi bo ca co da de di do fa fe fi ga go la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де ди до за ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се та те ти то".split(),
    "greek": "βα βε γα γε δα δε δι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι τα τε τι το".split(),
}
ENDINGS = {
    ("latin", "f"): ["na", "ra", "lia", "sa"],
    ("latin", "m"): ["n", "rd", "s", "ld"],
    ("latin", "u"): ["l", "r", "n", "t"],
    ("cyrillic", "f"): ["на", "ра", "лия", "са"],
    ("cyrillic", "m"): ["н", "р", "й", "л"],
    ("cyrillic", "u"): ["н", "р", "к", "л"],
    ("greek", "f"): ["να", "ρα", "λία", "σα"],
    ("greek", "m"): ["νος", "ρης", "λος", "σης"],
    ("greek", "u"): ["ν", "ς", "ρ", "λ"],
}

_ALL_TITLES = sorted((t for group in TITLES.values() for t in group), key=len, reverse=True)
_ALL_GIVEN = sorted((g for group in GIVEN.values() for g in group), key=len, reverse=True)
_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩΆ-ΏА-ЯЁ"
_SMALL = "a-zß-öø-ÿα-ωά-ώа-яё"
_NAME = rf"[{_CAPITAL}][{_SMALL}]+(?:-[{_CAPITAL}][{_SMALL}]+)?"
_GROUPS = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

_NUMBERS = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?:(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)\b)[\"']?\s{0,4}[:=]\s{0,4}[\"']?(?P<secret>[A-Za-z0-9_/+=.-]{8,}))"
    r"|(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}?::{_GROUPS}?)(?![\w:]|\.\d))"
    rf"|(?P<ipv4>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)(?!\w))"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}(?:\8\d{4}){1,2}\8?\d{1,4})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+[2-9]\d{0,2}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]\d{2,8}){1,3}(?!\.\d)|\+[2-9]\d{8,13}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))"
)
_GAP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(_ALL_TITLES)})\b\.?{_GAP}(?P<first>{_NAME})(?:{_GAP}(?P<last>{_NAME}))?")
_NAMED = re.compile(rf"\b(?P<first>{'|'.join(_ALL_GIVEN)}){_GAP}(?P<last>{_NAME})")
# Words that open lines and are no names.
_OPENERS = frozenset(
    (
        "The This That These Those There Then They He She It We You His Her Its Our Your My In On At By For From With Without As "
        "And But Or So If When While Where Who What Why How Not No Yes All An After Before Because Since To Of Is Are Was Were "
        "Der Die Das Ein Eine Und Aber Wenn Er Sie Es Wir Ich Le La Les Un Une Et Mais Il Elle El Los Las Una Pero Dans En"
    ).split()
)
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names} | {
    title: gender for gender, names in TITLES.items() for title in names
}
_WORD = re.compile(r"\w")
_LOOKS = re.compile(r"[0-9@]")
_NAME_WORDS = frozenset(name.encode() for name in _GENDER)
_BREAKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Found:
    """A place in a text: the entity's kind and normal form, and the original spelling."""

    start: int
    end: int
    kind: str
    value: str


# --- finding ---------------------------------------------------------------------


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(name: str) -> str:
    for c in name:
        if c.isalpha():
            word = unicodedata.name(c, "LATIN").split()[0].lower()
            return word if word in SYLLABLES else "latin"
    return "latin"


def _name_kind(part: str, gender: str, name: str) -> str:
    return f"{part}-{gender}-{script_of(name)}"


def find(text: str) -> list[Found]:
    """Entities of a text from left to right, without overlaps."""
    out: list[Found] = []
    if _LOOKS.search(text):
        for match in _NUMBERS.finditer(text):
            kind = match.lastgroup if match.lastgroup != "key" else "secret"
            if match["secret"]:
                kind = "secret"
            start, end = match.span("secret") if match["secret"] else match.span()
            raw = text[start:end]
            if kind == "iban":
                value = raw.replace(" ", "")
                if not 15 <= len(value) <= 34 or iban_rest(value) != 1:
                    continue
            elif kind == "card":
                value = re.sub(r"\D", "", raw)
                if len(value) != 16 and luhn_digit(value[:-1]) != int(value[-1]):
                    continue
            elif kind == "phone":
                value = re.sub(r"[^\d+]", "", raw)
                if not 7 <= len(value.lstrip("+")) <= 15:
                    continue
            elif kind == "email":
                value = raw.lower()
            elif kind == "ipv6":
                value = raw.lower()
                if not _is_ipv6(value):
                    continue
            elif kind == "secret":
                raw = raw.rstrip(".")
                end, value = start + len(raw), raw
                if not any(c.isdigit() for c in value):
                    continue
            else:
                value = raw
            out.append(Found(start, end, kind, value))
    words = text.encode("utf-8", "surrogatepass").translate(_BREAKS).split()
    if not _NAME_WORDS.isdisjoint(words):
        _find_names(text, out)
        _find_mentions(text, out)
    out.sort(key=lambda f: (f.start, -f.end))
    kept: list[Found] = []
    for f in out:
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
    return kept


def _find_names(text: str, out: list[Found]) -> None:
    """Names behind a title, and given names with a family name."""
    spans = {(f.start, f.end) for f in out}
    for match in _TITLED.finditer(text):
        if _opens_line(text, match, "first"):
            continue
        gender = _GENDER[match["title"]]
        if gender == "u":
            gender = _GENDER.get(match["first"], "u")
        if match["last"] and not _opens_line(text, match, "last"):
            out.append(Found(*match.span("first"), _name_kind("given", gender, match["first"]), match["first"].lower()))
            out.append(Found(*match.span("last"), _name_kind("family", "u", match["last"]), match["last"].lower()))
            spans |= {match.span("first"), match.span("last")}
        else:
            out.append(Found(*match.span("first"), _name_kind("family", "u", match["first"]), match["first"].lower()))
            spans.add(match.span("first"))
    for match in _NAMED.finditer(text):
        if _opens_line(text, match, "last"):
            continue
        for part in ("first", "last"):
            if match.span(part) not in spans:
                gender = _GENDER[match["first"]] if part == "first" else "u"
                kind = _name_kind("given" if part == "first" else "family", gender, match[part])
                out.append(Found(*match.span(part), kind, match[part].lower()))
                spans.add(match.span(part))


def _opens_line(text: str, match: re.Match, part: str) -> bool:
    """Whether the part is a word that opens the next line instead of a name."""
    return match[part] in _OPENERS and text[: match.start(part)].rstrip(" \t").endswith("\n")


def _find_mentions(text: str, out: list[Found]) -> None:
    """Further mentions of the names found, as words, in their spelling or in capitals."""
    spans = {(f.start, f.end) for f in out}
    kinds: dict[str, tuple[str, str]] = {}
    for f in sorted((f for f in out if "-" in f.kind), key=lambda f: f.start):
        name = text[f.start : f.end]
        if name not in _OPENERS:
            kinds.setdefault(name, (f.kind, f.value))
            kinds.setdefault(name.upper(), (f.kind, f.value))
    for name, (kind, value) in kinds.items():
        start = text.find(name)
        while start >= 0:
            end = start + len(name)
            bounded = not _WORD.match(text[start - 1 : start]) and not _WORD.match(text[end : end + 1])
            if bounded and (start, end) not in spans:
                out.append(Found(start, end, kind, value))
            start = text.find(name, end)


def _is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text)


# --- keyed permutations -----------------------------------------------------------


def _stream(key: bytes, tweak: str, data: list[int], n: int) -> list[int]:
    out, block = [], 0
    message = repr((tweak, data)).encode()
    while len(out) < n:
        digest = hashlib.blake2b(message + block.to_bytes(4, "big"), key=key, digest_size=64).digest()
        out += [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 64, 4)]
        block += 1
    return out[:n]


def permute(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of sequences whose positions have the given radices."""
    half = len(symbols) // 2
    left, right = symbols[:half], symbols[half:]
    base = [radices[:half], radices[half:]]
    for step in range(ROUNDS):
        if step % 2 == 0:
            noise = _stream(key, f"{tweak}/{step}/{radices}", left, len(right))
            right = [(x + y) % r for x, y, r in zip(right, noise, base[1])]
        else:
            noise = _stream(key, f"{tweak}/{step}/{radices}", right, len(left))
            left = [(x + y) % r for x, y, r in zip(left, noise, base[0])]
    return left + right


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _alphabets(text: str, hexadecimal: bool = False) -> list[str | None]:
    """For each character the alphabet that it stays in, if any."""
    if hexadecimal:
        sets = _HEX[:1] if text == text.lower() else _HEX[1:]
    else:
        sets = _CLASSES
    return [next((s for s in sets if c in s), None) for c in text]


def shape_permute(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    alphabets = _alphabets(text, hexadecimal)
    used = [(c, a) for c, a in zip(text, alphabets) if a]
    made = permute([a.index(c) for c, a in used], [len(a) for _, a in used], key, tweak)
    found = iter(made)
    return "".join(a[next(found)] if a else c for c, a in zip(text, alphabets))


def _is_hex(text: str) -> bool:
    plain = text.replace("-", "")
    return bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", plain)) and any(c.isalpha() for c in plain) and len(plain) >= 8


def _country(digits: str) -> int:
    """Length of the country code of a number that starts with a plus sign."""
    return 1 if digits[:1] in ("1", "7") else 2


def _phone_parts(value: str) -> tuple[str, str, str, str]:
    plus = "+" if value.startswith("+") else ""
    digits = value.lstrip("+")
    code = digits[: _country(digits)] if plus else ""
    rest = digits[len(code) :]
    if len(rest) == 10 and rest[3:6] == "555":
        return plus + code, rest[:3], "555", rest[6:]
    return plus + code, rest, "", ""


def _domain(domain: str, key: bytes) -> str:
    reserved = re.search(r"(?:^|\.)example\.(?:com|net|org)$", domain)
    if reserved:
        start = reserved.start()
        return shape_permute(domain[:start], key, "domain") + domain[start:]
    name, _, top = domain.rpartition(".")
    return f"{shape_permute(name, key, 'domain')}.{top}.example"


def shape(kind: str, value: str) -> str:
    """The set of strings that a surrogate is taken from."""
    if kind == "email":
        local, _, domain = value.partition("@")
        return re.sub(r"[a-z]", "a", re.sub(r"\d", "9", local)) + "@" + domain
    if kind == "phone":
        head, first, middle, last = _phone_parts(value)
        return f"{head}({len(first)}){middle}({len(last)})"
    if kind == "secret" and _is_hex(value):
        return f"hex{re.sub('[0-9a-fA-F]', '0', value)}{value == value.lower()}"
    if kind == "iban":
        return value[:2] + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value[4:]))
    if kind == "ipv6":
        return re.sub("[0-9a-f]", "0", value)
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", value)))


def domain_size(kind: str, value: str) -> float:
    """Number of strings of the value's shape."""
    if "-" in kind:  # names grow with the attempts
        return float("inf")
    if kind == "ipv4":
        return 2.0**32
    body = value.partition("@")[0] if kind == "email" else value[4:] if kind == "iban" else value
    if kind == "phone":
        body = "".join(_phone_parts(value)[1::2])
    elif kind == "card":
        body = value[:-1]
    size = 1.0
    for alphabet in _alphabets(body, kind == "ipv6" or (kind == "secret" and _is_hex(value))):
        size *= len(alphabet) if alphabet else 1
    return size


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """Normal form of the surrogate."""
    tweak = f"{kind}/{attempt}"
    if "-" in kind:
        return _name(kind, value, key, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        return shape_permute(local, key, f"{tweak}/{domain}") + "@" + _domain(domain, key)
    if kind == "phone":
        head, first, middle, last = _phone_parts(value)
        digits = shape_permute(first + last, key, f"{tweak}/{head}")
        return head + digits[: len(first)] + middle + digits[len(first) :]
    if kind == "card":
        payload = shape_permute(value[:-1], key, tweak)
        wrong = (int(value[-1]) - luhn_digit(value[:-1])) % 10
        return payload + str((luhn_digit(payload) + wrong) % 10)
    if kind == "iban":
        body = shape_permute(value[4:], key, f"{tweak}/{value[:2]}")
        return f"{value[:2]}{98 - iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind == "ipv4":
        number = [int(x) for x in value.split(".")]
        return ".".join(map(str, permute(number, [256] * 4, key, tweak)))
    return shape_permute(value, key, tweak, kind == "ipv6" or (kind == "secret" and _is_hex(value)))


def _name(kind: str, value: str, key: bytes, attempt: int) -> str:
    part, gender, script = kind.split("-")
    syllables = SYLLABLES[script]
    count = max(2, min(4, len(value) // 3)) + attempt // 4
    picks = _stream(key, f"{kind}/{attempt}", [ord(c) for c in value], count + 1)
    body = "".join(syllables[p % len(syllables)] for p in picks[:count])
    endings = ENDINGS[script, gender if part == "given" else "u"]
    return body + endings[picks[count] % len(endings)]


def spelled(kind: str, original: str, value: str) -> str:
    """The surrogate in the original's punctuation and case."""
    if "-" in kind:
        return value.upper() if original.isupper() else value.capitalize()
    if kind in ("phone", "card", "iban"):
        made, out = iter(value.replace("+", "") if kind == "phone" else value), []
        for c in original:
            out.append(next(made) if c.isalnum() else c)
        return "".join(out)
    if kind in ("email", "ipv6") and original != original.lower() and original == original.upper():
        return value.upper()
    return value


def rewrite(text: str, key: bytes, settled: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of entities by kind. `settled` tells the kind and attempt of those
    entities that take another kind than the mention's, or not the first attempt."""
    out, at, counts = [], 0, {}
    for f in find(text):
        kind, attempt = settled.get((f.kind, f.value), (f.kind, 0))
        made = surrogate(kind, f.value, key, attempt)
        out += [text[at : f.start], spelled(f.kind, text[f.start : f.end], made)]
        at = f.end
        name = f.kind.partition("-")[0]
        counts[name] = counts.get(name, 0) + 1
    return "".join(out) + text[at:] if out else text, counts


# --- on tables --------------------------------------------------------------------


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (``kind``, ``value``) of the table; a task repeats what it finds at most by batch."""
    bound_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(f.kind, f.value) for text in batch.column(0).to_pylist() if text for f in find(text)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    return docs.select(column(docs, text_col).cast("string")).mapInArrow(gather, "kind string, value string").distinct()


def _tried(todo: DataFrame, key: bytes, attempt: int) -> DataFrame:
    schema = "kind string, value string, attempt int, made string, shape string, room double"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kind"),
                    batch.column("value"),
                    pa.array([attempt] * len(pairs), pa.int32()),
                    pa.array([surrogate(k, v, key, attempt) for k, v in pairs], pa.string()),
                    pa.array([shape(k, v) for k, v in pairs], pa.string()),
                    pa.array([domain_size(k, v) for k, v in pairs], pa.float64()),
                ],
                ["kind", "value", "attempt", "made", "shape", "room"],
            )

    return todo.select("kind", "value").mapInArrow(make, schema)


def told_genders(known: DataFrame) -> DataFrame:
    """(``kind``, ``value``, ``used``): given names of a mention without gender, and the kind of the one gender that
    the name has elsewhere."""
    parts = F.split("kind", "-")
    given = known.filter(F.col("kind").startswith("given-")).select("value", parts[1].alias("gender"), parts[2].alias("script"))
    by_name = given.groupBy("value", "script").agg(*[F.max(F.col("gender") == g).alias(g) for g in "fmu"])
    told = by_name.filter(F.col("u") & (F.col("f") != F.col("m")))
    used = F.concat(F.when(F.col("f"), "given-f-").otherwise("given-m-"), "script")
    return told.select(F.concat(F.lit("given-u-"), "script").alias("kind"), "value", used.alias("used"))


def _drawn_from() -> Column:
    """The set that an entity's surrogate must be distinct in: its kind, or all names of its script."""
    return F.when(F.col("kind").contains("-"), F.concat(F.lit("name-"), F.substring_index("kind", "-", -1))).otherwise(F.col("kind"))


def later_attempts(known: DataFrame, key: bytes, make=_tried) -> DataFrame:
    """(``kind``, ``value``, ``attempt``) of the entities whose first surrogate is not theirs alone."""
    taken = written(make(known, key, 0).withColumn("pool", _drawn_from()), "pii-taken")
    real = known.select(_drawn_from().alias("pool"), F.col("value").alias("made"))
    crowd = taken.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("room").alias("room"))
    full = written(crowd.filter(F.col("n") * FULL > F.col("room")).select("kind", "shape"), "pii-full")
    free = taken.join(full, ["kind", "shape"], "left_anti")
    fixed = taken.join(full, ["kind", "shape"], "left_semi")
    settled_parts = [written(fixed, "pii-settled")]
    todo, attempt = written(free, "pii-todo"), 0
    while True:
        fresh = todo.join(real, ["pool", "made"], "left_anti")
        for part in settled_parts:
            fresh = fresh.join(part.select("pool", "made"), ["pool", "made"], "left_anti")
        first = fresh.groupBy("pool", "made").agg(F.min(F.struct(F.xxhash64("value").alias("h"), "value", "kind")).alias("first"))
        winners = written(first.select("pool", "first.kind", "first.value", "made").withColumn("attempt", F.lit(attempt)), "pii-settled")
        settled_parts.append(winners)
        losers = written(todo.join(winners, ["kind", "value"], "left_anti").select("kind", "value"), "pii-losers")
        remove(todo)
        if not losers.limit(1).count():
            break
        attempt += 1
        if attempt >= MAX_ATTEMPTS:
            raise RuntimeError(f"entities without a surrogate of their own after {attempt} attempts: {losers.take(5)}")
        todo = written(make(losers, key, attempt).withColumn("pool", _drawn_from()), "pii-todo")
    late = settled_parts[1].select("kind", "value", "attempt")
    for part in settled_parts[2:]:
        late = late.unionByName(part.select("kind", "value", "attempt"))
    return written(late.filter("attempt > 0"), "pii-late")


def with_surrogates(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast: bool | None = None, make=_tried
) -> DataFrame:
    """The documents with surrogates in their texts, and ``entities``: their number by kind.

    `broadcast` says how the later attempts come to the texts; by default their size decides.
    """
    known = written(entities(docs, text_col), "pii-entities")
    told = written(told_genders(known), "pii-told")
    settled = written(known.join(told.select("kind", "value"), ["kind", "value"], "left_anti"), "pii-own")
    attempts = later_attempts(settled, key, make).select(F.col("kind").alias("used"), "value", "attempt")
    others = told.join(attempts, ["used", "value"], "left").select("kind", "value", "used", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    late = written(attempts.select(F.col("used").alias("kind"), "value", "used", "attempt").unionByName(others), "pii-late")
    remove(known, settled)
    kept = docs.drop("entities")
    schema = T.StructType([*kept.schema.fields, T.StructField("entities", T.MapType(T.StringType(), T.LongType()))])
    if broadcast is None:
        broadcast = fits(docs.sparkSession, measure(late))
    names = list(kept.schema.names)
    place = names.index(text_col)

    def renew(batch: pa.RecordBatch, tables: list[dict]) -> pa.RecordBatch:
        texts, counts = [], []
        for text, attempts in zip(batch.column(place).to_pylist(), tables):
            made, n = rewrite(text, key, attempts) if text else (text, {})
            texts.append(made)
            counts.append(sorted(n.items()))
        columns = list(batch.columns[: len(names)])
        columns[place] = pa.array(texts, pa.string())
        made = pa.array(counts, pa.map_(pa.string(), pa.int64()))
        return pa.RecordBatch.from_arrays([*columns, made], [f.name for f in schema.fields])

    if broadcast:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): (r["used"], r["attempt"]) for r in late.collect()})

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield renew(batch, [shared.value] * batch.num_rows)

        return map_arrow(kept, replace, schema)

    hashed, looked_up = free_names(kept, "hash", "late")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, kinds, values = [], [], []
            for code, text in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist()):
                found = {(f.kind, f.value) for f in find(text)}
                hashes += [code] * len(found)
                kinds += [k for k, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["h", "kind", "value"])

    text = column(kept, text_col).cast("string")
    places = kept.select(F.xxhash64(text).alias("h"), text.alias("t")).filter("t is not null").mapInArrow(gather, "h long, kind string, value string")
    needed = places.join(late, ["kind", "value"]).groupBy("h").agg(F.collect_set(F.struct("kind", "value", "used", "attempt")).alias(looked_up))
    needed = written(needed.withColumnRenamed("h", hashed), "pii-needed")
    joined = kept.join(needed, F.xxhash64(text) == needed[hashed], "left").drop(hashed)

    def replace_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            tables = [{(e["kind"], e["value"]): (e["used"], e["attempt"]) for e in row or []} for row in found]
            yield renew(batch, tables)

    return map_arrow(joined, replace_joined, schema)
