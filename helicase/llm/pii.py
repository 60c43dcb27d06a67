"""Surrogates for personal data: entities are found by patterns with check digits and replaced by keyed, type-consistent ones.

A surrogate is a keyed function of the entity alone, so one entity has one surrogate in all documents, without an
exchange between them, and executors that are lost change nothing. Each function is a bijection without fixed points
on the entities of its shape (see fpe): different entities keep different surrogates by construction, at any number
of them. Where only some strings of a shape are valid, the bijection is one of the valid ones: card numbers keep their
brand and a valid check digit, telephone numbers valid area codes, addresses stay public or in their private block,
given names stay in the lexicon of their gender and script. Other names get an ending that tells whether they are a
man's, a woman's or neither, so that names of different genders can't meet. ``collisions`` verifies distinctness on
what a run replaced.

Types: private_key, email, secret, iban, card, phone, ssn, ip, name. A number of 13 to 19 digits is a card only with
a brand's prefix and a valid check digit, so order numbers stay. Telephone numbers are found with a +, in the North
American forms, and in the national forms of Germany, France and Spain. Names are found after a title or by a given
name of the lexicon; later mentions of either part in the same document follow. A given name that isn't in the lexicon
has its title's gender, or that of another mention in the document; two of different genders are two entities.

Defined cases: a null text stays null and an empty one empty, both without entities; repeated rows get equal results;
texts are worked on whole; other columns stay, and a column named like the output column is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c
from helicase.llm import _windows as win
from helicase.llm import fpe

#: Given names by (script, gender); a surrogate comes from the list of the original.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Sophie Clara Elena Carmen Lucia Marta Ingrid Helga Petra Claire Camille Chloe Alice Emily Hannah Olivia Grace Nora".split(),
    ("latin", "m"): "John James Robert Michael William David Thomas Peter Paul Hans Klaus Stefan Jürgen Pierre Jean Antoine Luc Carlos Miguel Javier Diego Pablo Oscar Henry".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел".split(),
}
LEXICON = {n.lower(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}
TITLES = {
    "m": r"Mr|Sir|Herr|Monsieur|Señor|Sr|г-н|господин|Господин",
    "f": r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Señorita|г-жа|госпожа|Госпожа",
    "": r"Dr|Prof",
}
WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"(?<![\w.+%-])[\w.+%-]+@(?:[\p{L}\d-]+\.)+\p{L}{2,}",
    "secret": r"""(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|auth[_ -]?key)\b["']?\s*[:=]\s*["']?(?P<value>[\w+/=.~-]{8,})(?<![.=])|(?P<value>(?<![\w-])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|sk-[\w-]{20,})(?![\w-]))""",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": "|".join((
        r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,5}){2,6}(?!\d)",
        r"(?<![\w.+(/-])(?:1[ .-])?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|[2-9]\d{2}(?:[.-]\d{3}[.-]| \d{3}[ -])\d{4})(?![.-]?\d)",
        r"(?<![\w.,+/-])0[1-9](?:[ .-]\d{2}){4}(?![ .-]?\d)",
        r"(?<![\w.,+/-])0[1-9]\d{1,3}(?:[ /-]\d{5,8}|[ /]\d{3,4} \d{3,5})(?![ .-]?\d)",
        r"(?<![\w.,+/-])[6-9]\d{2}(?:(?: \d{2}){3}| \d{3} \d{3})(?![ .-]?\d)",
    )),
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)|(?<![:\w])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|[0-9a-fA-F]{3,4}:(?:[0-9a-fA-F]{0,4}:){1,6}[0-9a-fA-F]{0,4})(?![:\w])",
}
FOUND = {k: regex.compile(p, regex.S) for k, p in PATTERNS.items()}
TITLED = regex.compile(r"(?<!\w)(?:" + "|".join(f"(?P<g{g}>{t})" for g, t in TITLES.items() if g) + rf"|{TITLES['']})\.? (?P<name>{WORD}(?: {WORD})?)")
KNOWN = regex.compile(rf"(?<!\w)(?P<given>{'|'.join(x for names in GIVEN.values() for x in names)}) (?P<family>{WORD})(?!\w)")
#: A text without any of these has no entity of the type.
NEEDS = {"private_key": "PRIVATE KEY", "email": "@", "ip": None}
DIGIT = regex.compile(r"\d")
BRANDS = regex.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|6(?:011|5\d\d|4[4-9]\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|62\d{14,17}")
#: Endings of names that aren't in the lexicon, by script and gender; no name of the lexicon has one.
ENDINGS = {"latin": {"f": "ela", "m": "ino", "": "ner"}, "cyrillic": {"f": "ела", "m": "ен", "": "ский"}}
SCRIPT = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}")}
#: Blocks of addresses that aren't public, as ranges in order.
RESERVED = sorted((int(n.network_address), int(n.broadcast_address) + 1) for n in map(ipaddress.IPv4Network, "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/3".split()))


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    text: str
    gender: str = ""


def check_digit(digits: str) -> str:
    """The Luhn digit that follows digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1


def _valid(kind: str, text: str) -> bool:
    digits = "".join(ch for ch in text if ch.isdigit())
    if kind == "card":
        return bool(BRANDS.fullmatch(digits)) and check_digit(digits[:-1]) == digits[-1]
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "iban":
        return iban_valid(text)
    if kind == "ip" and ":" in text:
        try:
            return bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    if kind == "secret":
        return any(ch.isdigit() for ch in text) or len(text) >= 20
    return True


def script_of(name: str) -> str | None:
    """The script of a name's last letter, if it is one with endings."""
    return next((k for k, p in SCRIPT.items() if p.match(name[-1])), None)


def find(text: str) -> list[Entity]:
    """Entities in order, without overlaps: of two that overlap, the type named first stays."""
    found: list[Entity] = []
    taken = bytearray(len(text))

    def add(e: Entity) -> None:
        if taken.find(1, e.start, e.end) < 0:
            taken[e.start : e.end] = b"\1" * (e.end - e.start)
            found.append(e)

    digits = bool(DIGIT.search(text))
    for kind, pattern in FOUND.items():
        if (need := NEEDS.get(kind)) and need not in text or kind in ("iban", "card", "phone", "ssn", "ip") and not digits:
            continue
        for m in pattern.finditer(text):
            i, j = m.span("value") if kind == "secret" else m.span()
            if _valid(kind, text[i:j]):
                add(Entity(i, j, kind, text[i:j]))
    # (start, word, in a given name's place, gender by the title)
    names: list[tuple[int, str, bool, str]] = []
    for m in TITLED.finditer(text):
        gender = "m" if m.group("gm") else "f" if m.group("gf") else ""
        words = m.group("name").split(" ")
        at = m.start("name")
        for w in words:
            first = len(words) > 1 and w is words[0]
            names.append((at, w, first or w.lower() in LEXICON, gender if first else ""))
            at += len(w) + 1
    for m in KNOWN.finditer(text):
        names += [(m.start("given"), m.group("given"), True, ""), (m.start("family"), m.group("family"), False, "")]
    if names:
        genders: dict[str, str] = {}
        for _, w, given, gender in names:
            if given and gender:
                genders.setdefault(w, gender)
        known: dict[str, tuple[str, str]] = {}
        for at, w, given, gender in names:
            kind = "given" if given and w.lower() in LEXICON else "name"
            gender = (gender or genders.get(w, "")) if given and kind == "name" and script_of(w) else ""
            known.setdefault(w, (kind, gender))
            add(Entity(at, at + len(w), kind, w, gender))
        for m in regex.finditer(r"(?<!\w)\L<names>(?!\w)", text, names=list(known)):
            add(Entity(*m.span(), known[m.group()][0], m.group(), known[m.group()][1]))
    return sorted(found, key=lambda e: e.start)


class Surrogates:
    """Surrogates under one key."""

    MOST = 1 << 17

    def __init__(self, key: bytes) -> None:
        self.key, self.known = key, {}

    def entity_id(self, e: Entity) -> str:
        """A keyed name of the entity, equal for all its mentions."""
        return hashlib.blake2b(f"{e.kind}|{e.gender}|{self.canonical(e)}".encode(), key=self.key[:64], digest_size=12).hexdigest()

    @staticmethod
    def canonical(e: Entity) -> str:
        if e.kind == "phone":
            digits = "".join(ch for ch in e.text if ch.isdigit())
            return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if e.kind in ("card", "iban", "ssn"):
            return "".join(ch for ch in e.text if ch.isalnum())
        if e.kind == "ip" and ":" in e.text:
            return ipaddress.IPv6Address(e.text).exploded
        return e.text.lower() if e.kind in ("email", "ip", "given", "name") else e.text

    def of(self, e: Entity) -> str:
        at = (e.kind, e.text, e.gender)
        if at not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[at] = self._name(e.text, e.gender) if e.kind == "name" else getattr(self, f"_{e.kind}")(e.text)
        return self.known[at]

    def _refill(self, text: str, chars: str) -> str:
        """chars in the places of text's letters and digits."""
        it = iter(chars)
        return "".join(next(it) if ch.isalnum() else ch for ch in text)

    def _private_key(self, text: str) -> str:
        head, tail = text.index("KEY-----") + 8, text.rindex("-----END")
        return text[:head] + self._secret(text[head:tail]) + text[tail:]

    def _secret(self, text: str) -> str:
        hexa = regex.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
        if not hexa:
            return fpe.replaced(text, self.key, "secret")
        x = fpe.moved(int(text, 16), 16 ** len(text), self.key, b"hex%d" % len(text))
        out = f"{x:0{len(text)}x}"
        return out.upper() if any(ch.isupper() for ch in text) else out

    def _email(self, text: str) -> str:
        tld = text.rindex(".")
        return fpe.replaced(text, self.key, "email", fixed=range(tld, len(text)))

    def _iban(self, text: str) -> str:
        s = text.replace(" ", "")
        body = fpe.replaced(s[4:], self.key, "iban" + s[:2])
        check = 98 - int("".join(str(int(ch, 36)) for ch in body + s[:2] + "00")) % 97
        return self._refill(text, f"{s[:2]}{check:02d}{body}")

    def _card(self, text: str) -> str:
        digits = "".join(ch for ch in text if ch.isdigit())
        # four digits settle the brand, or a first 4; whatever follows is valid
        body = fpe.replaced(digits[:-1], self.key, "card", fixed=range(1 if digits[0] == "4" else 4))
        return self._refill(text, body + check_digit(body))

    def _phone(self, text: str) -> str:
        digits = "".join(ch for ch in text if ch.isdigit())
        north_american = digits[0] != "0" and (len(digits) == 10 or len(digits) == 11 and digits[0] == "1")
        head = len(digits) - 10 if north_american else min(2, len(digits) - 6)
        # area and exchange codes begin with 2 to 9; numbers that break that stay among those that do
        body = digits[head:]
        codes = {i: "01" if body[i] in "01" else "23456789" for i in (0, 3)} if north_american else None
        return self._refill(text, digits[:head] + fpe.replaced(body, self.key, "phone", allowed=codes))

    def _ssn(self, text: str) -> str:
        area, group, serial = (int(x) for x in text.split("-"))
        rank = area - 1 - (area > 666)  # areas are 1 to 899 but for 666
        x = fpe.moved((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, self.key, b"ssn")
        rest, serial = divmod(x, 9999)
        rank, group = divmod(rest, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, text: str) -> str:
        if ":" in text:
            whole = ipaddress.IPv6Address(text)  # its first group, which tells what kind of address it is, stays
            head, rest = divmod(int(whole), 1 << 112)
            new = ipaddress.IPv6Address((head << 112) + fpe.moved(rest, 1 << 112, self.key, b"ip6|%d" % head))
            out = new.compressed if len(text) < 39 else new.exploded
            return out.upper() if any(ch.isupper() for ch in text) else out
        x = int(ipaddress.IPv4Address(text))
        block = next(((lo, hi) for lo, hi in RESERVED if lo <= x < hi), None)
        if block:  # stays in its block
            lo, hi = block
            return str(ipaddress.IPv4Address(lo + fpe.moved(x - lo, hi - lo, self.key, b"ip%d" % lo)))
        x = fpe.moved(x - sum(hi - lo for lo, hi in RESERVED if hi <= x), (1 << 32) - sum(hi - lo for lo, hi in RESERVED), self.key, b"ip")
        for lo, hi in RESERVED:
            x += hi - lo if x >= lo else 0
        return str(ipaddress.IPv4Address(x))

    def _given(self, text: str) -> str:
        kind, i = LEXICON[text.lower()]
        names = GIVEN[kind]
        out = names[fpe.moved(i, len(names), self.key, "|".join(kind).encode())]
        return out.upper() if text.isupper() else out

    def _name(self, text: str, gender: str = "") -> str:
        """A name out of the lexicon: another body of the same shape, and the ending of its gender and script, by which
        names of other genders and of the lexicon differ from it."""
        script = script_of(text)
        body = fpe.replaced(text, self.key, f"name|{gender}" if script else "name", spoken=True)
        return body + ENDINGS[script][gender] if script else body

    def rewrite(self, text: str) -> tuple[str, list[dict]]:
        """text with surrogates, and what was replaced; positions are in the new text."""
        out, spans, at, size = [], [], 0, 0
        for e in find(text):
            new = self.of(e)
            out += [text[at : e.start], new]
            size += e.start - at
            kind = "name" if e.kind == "given" else e.kind
            spans.append({"type": kind, "start": size, "end": size + len(new), "entity": self.entity_id(e), "surrogate": self.canonical(Entity(0, 0, e.kind, new))})
            size += len(new)
            at = e.end
        return ("".join([*out, text[at:]]) if spans else text), spans


SPANS = "array<struct<type:string,start:int,end:int,entity:string,surrogate:string>>"
SPANS_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surrogate", pa.string())]))


def _rewrite(key: bytes, text: int) -> Callable:
    def run(tables) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in win.batches(tables, text):
            done = [(None, []) if t is None else surrogates.rewrite(t) for t in b.column(text).to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if k == text else x for k, x in enumerate(b.columns)]
            yield pa.record_batch([*columns, pa.array([s for _, s in done], SPANS_ARROW)], names=[*b.schema.names, "__entities"])

    return run


def pseudonymize(df: DataFrame, key: bytes, text_col: str = "text", out: str = "entities") -> DataFrame:
    """df with surrogates in the text column, and ``out``: what was replaced, by type, place in the new text, keyed id and surrogate."""
    keep = [x for x in df.columns if x != out]
    if text_col not in keep:
        raise ValueError(f"{text_col!r} is no column, or the output column")
    inner = [f"__p{i}" for i in range(len(keep))]
    d = c.ship(df).select(*[F.col(f"`{x}`").alias(y) for x, y in zip(keep, inner, strict=True)])
    schema = d.withColumn("__entities", F.array().cast(SPANS)).schema
    d = d.mapInArrow(_rewrite(key, keep.index(text_col)), schema)
    return d.select(*[F.col(y).alias(x) for x, y in zip(keep, inner, strict=True)], F.col("__entities").alias(out))


def collisions(df: DataFrame, entities: str = "entities") -> DataFrame:
    """(type, surrogate, originals) of surrogates that stand for two or more entities: empty, unless something is wrong."""
    e = df.select(F.explode(entities).alias("e")).select("e.type", "e.surrogate", "e.entity").distinct()
    return e.groupBy("type", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")


#: The queries' key. Whoever rewrites real data passes a secret of their own.
DEMO_KEY = b"helicase demonstration key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymize(c.table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return d.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
