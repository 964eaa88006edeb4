"""Personal data: detected entities receive keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_small, table

#: Given names by script and gender; a name is replaced by another of its row. Fixed values.
GIVEN = {
    ("latin", "f"): "Alice Amelia Ana Anna Beatrice Camille Carla Carmen Charlotte Claire Clara Elena Elisa Emily Emma Eva Frieda Greta Hannah Helen Ines Ingrid Isabel Jane Julia Karin Laura Lena Lucia Maria Marie Marta Mary Nina Olivia Paula Rosa Sarah Sofia Sophie".split(),
    ("latin", "m"): "Adam Albert Andre Antonio Arthur Benjamin Carlos Charles Daniel David Diego Edward Emil Felix Frank Fritz George Hans Henri Henry Hugo Jack James Jean John Jorge Jose Karl Louis Lucas Luis Martin Michael Oscar Otto Paul Peter Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Titles before a name, by the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Dr": "", "Prof": ""}
#: Letters that stand for each other in made-up names.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
_CLASS = {c: k for k, letters in enumerate(CLASSES) for c in letters}
_GIVEN_NAMES = frozenset(name for names in GIVEN.values() for name in names)
_POOL = {name.lower(): (key, k) for key, names in GIVEN.items() for k, name in enumerate(names)}
#: Domains that name nobody stay as they are.
PUBLIC_DOMAINS = ("example.com", "example.org", "example.net", "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "gmx.de", "web.de", "orange.fr")

#: A space is crowded if more than one value in so many is an entity. From this size on no space is.
CROWDED, LARGE = 4, 1 << 40

#: Networks of special use, a fixed value.
NETWORKS = [ipaddress.IPv4Network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4".split()]

_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|auth|passwd|password|secret|token)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/]{12,})")
_NUMBER = re.compile(
    r"(?<![\w.])(?:(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d{8,14})(?![\w-])"
    r"|(?P<short>\d{3}[ .-]\d{4})(?![\w-]))"
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ώ][a-zà-öø-ÿа-яёά-ώ]+"
_CAPITALS = re.compile(_NAME)
#: Words that may mention a name again, and the parts of hyphenated ones.
_WORDS, _PART = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ώ][^\W\d_]+(?:-[^\W\d_]+)*(?!\w)"), re.compile(r"[^\W\d_]+")
_TITLED = re.compile(rf"\b({'|'.join(TITLES)})\.?[ \t]+({_NAME}(?:-{_NAME})?)(?:[ \t]+({_NAME}(?:-{_NAME})?))?")
_LISTED = f"(?:{'|'.join(n for names in GIVEN.values() for n in names)})"
_GIVEN = re.compile(rf"\b((?:{_LISTED}[ \t]+)+)({_NAME}(?:-{_NAME})?)\b")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
#: Numbers that only the word before them tells.
_PHONE_WORD = re.compile(r"(?i)\b(?:tel|telephone|phone|fax|mobile|cell|call)\b[^\w\n]{1,3}\Z")
_PASSPORT = re.compile(r"(?i)\bpassport\b(?:[ \t]+(?:no|nr|number)\b)?[^\w\n]{1,3}([A-Z]{0,2}\d{6,9})(?!\w)")
#: The part of an IPv6 address that changes; what precedes it tells the kind of network.
_HOST_BITS = 112


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ipv6(text: str) -> bool:
    """Whether a text is an address with a digit and three groups or more; clock times and names with two colons are not."""
    if sum(map(bool, text.split(":"))) < 3 or text.isalpha() or not any(c.isdigit() for c in text):
        return False
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _name_kind(name: str) -> str:
    """Given with a gender for a listed name, surname for any other: by the name alone, so that it has one surrogate wherever it stands and whichever title it has."""
    pooled = _POOL.get(name.lower())
    return "given" + pooled[0][1] if pooled else "surname"


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, by start and without overlaps: the one that starts first stays.

    A name that is found once, by a title or a listed given name, is found wherever the text has it.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    found += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    found += [(*m.span(), "iban") for m in _IBAN.finditer(text) if _iban_ok(m[0].replace(" ", ""))]
    if "::" in text or text.count(":") >= 7:
        found += [(*m.span(), "ipv6") for m in _IPV6.finditer(text) if _ipv6(m[0])]
    if "assport" in text or "ASSPORT" in text:
        found += [(*m.span(1), "passport") for m in _PASSPORT.finditer(text)]
    for m in _NUMBER.finditer(text):
        kind, digits = m.lastgroup, re.sub(r"\D", "", m[0])
        if kind == "ip" and not all(int(x) < 256 for x in m[0].split(".")):
            continue
        if kind == "card" and not (luhn(digits) or len(digits) in (15, 16) and digits[0] in "3456"):
            continue
        if kind == "short":
            if not _PHONE_WORD.search(text, max(0, m.start() - 16), m.start()):
                continue
            kind = "phone"
        elif kind == "phone" and not (9 <= len(digits) <= 15 or m[0][0] in "+(" and len(digits) >= 7):
            continue
        found.append((*m.span(), kind))
    words = set(_CAPITALS.findall(text))
    if not words.isdisjoint(TITLES):
        for m in _TITLED.finditer(text):
            found += [(*m.span(k), _name_kind(m[k])) for k in (2, 3) if m[k]]
    if not words.isdisjoint(_GIVEN_NAMES):
        for m in _GIVEN.finditer(text):
            given = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"\S+", m[1])]
            if [text[lo:hi] for lo, hi in given] != [m[2]]:
                found += [(lo, hi, _name_kind(text[lo:hi])) for lo, hi in (*given, m.span(2))]
    out, end = [], -1
    for lo, _, hi, kind in sorted((lo, k, hi, kind) for k, (lo, hi, kind) in enumerate(found)):
        if lo >= end:
            out.append((lo, hi, kind))
            end = hi
    return _with_mentions(text, out)


def _with_mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """found, and all other mentions of the names among it: as they are or in capitals, also with a genitive s."""
    names: dict[str, str] = {}
    for lo, hi, kind in found:
        if kind == "surname" or kind.startswith("given"):
            names.setdefault(text[lo:hi], kind)
    if not names:
        return found
    for name in list(names):
        if len(name) > 3:  # shorter words in capitals are abbreviations
            names.setdefault(name.upper(), names[name])
    out, k = [], 0
    for m in _WORDS.finditer(text):
        lo, word = m.start(), m[0]
        name = next((n for n in (word, word[:-1] if word[-1] in "sS" else "") if n in names), None)
        parts = [(lo, name)] if name else [(lo + p.start(), p[0]) for p in _PART.finditer(word)] if "-" in word else []
        for at, part in parts:
            while k < len(found) and found[k][1] <= at:
                out.append(found[k])
                k += 1
            part = next((n for n in (part, part[:-1] if part[-1] in "sS" else "") if n in names), None)
            if part and (k == len(found) or at + len(part) <= found[k][0]):
                out.append((at, at + len(part), names[part]))
    return out + found[k:]


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def canonical(kind: str, value: str) -> str:
    """What two mentions of the same entity have in common."""
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return digits[-10:] if len(digits) > 10 else digits
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    return value.lower() if kind in ("email", "surname") or kind.startswith("given") else value


class Cipher:
    """Keyed permutations of 0..n-1 without fixed points: a Feistel network, walked until it falls below n, around a step of one."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, label: bytes, r: int, x: int, bits: int) -> int:
        h = hashlib.blake2b(label + bytes([r]) + x.to_bytes(-(-max(1, x.bit_length()) // 8), "little"), key=self.key, digest_size=max(1, -(-bits // 8))).digest()
        return int.from_bytes(h, "little") & ((1 << bits) - 1)

    def _pass(self, label: bytes, x: int, bits: int, back: bool) -> int:
        low = bits // 2
        a, b, wa, wb = x >> low, x & ((1 << low) - 1), bits - low, low
        if not back:
            for r in range(self.ROUNDS):
                a ^= self._round(label, r, b, wa)
                a, b, wa, wb = b, a, wb, wa
        else:
            for r in reversed(range(self.ROUNDS)):
                a, b, wa, wb = b, a, wb, wa
                a ^= self._round(label, r, b, wa)
        return a << low | b

    def _walk(self, label: bytes, x: int, n: int, back: bool) -> int:
        bits = max(2, (n - 1).bit_length())
        while True:
            x = self._pass(label, x, bits, back)
            if x < n:
                return x

    def move(self, label: bytes, x: int, n: int) -> int:
        if n < 2:
            return x
        return self._walk(label, (self._walk(label, x, n, False) + 1) % n, n, True)

    def spell(self, label: str, text: str, alphabets: list[str]) -> str:
        """Another string over the same alphabets, position by position; characters without one ("") stay."""
        x, n = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        x, out = self.move(f"{label}|{[len(a) for a in alphabets]}".encode(), x, n), []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                x, k = divmod(x, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(text: str) -> list[str]:
    return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "" for c in text]


def _walked(start: str, step, ok) -> str:
    x = step(start)
    while not ok(x):
        x = step(x)
    return x


def surrogate(cipher: Cipher, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a canonical value. For one attempt no two values of a kind share one, and none is its own."""
    label = f"{kind}#{attempt}"
    spell = lambda v: cipher.spell(label, v, _plain(v))
    if kind == "email":
        local, _, domain = value.partition("@")
        keep = next((d for d in PUBLIC_DOMAINS if domain == d or domain.endswith("." + d)), "." + domain.rpartition(".")[2])
        own = domain[: -len(keep)]
        moved = domain if keep in PUBLIC_DOMAINS else cipher.spell(label + "@", own, _plain(own)) + keep
        if any(_plain(local)):
            return f"{cipher.spell(f'{label}{moved}', local, _plain(local))}@{moved}"
        return f"{local}@{moved}"
    if kind == "phone":
        return _walked(value, spell, lambda v: (v[0] in "01") == (value[0] in "01"))
    if kind == "card":
        return value[0] + _walked(value[1:], spell, lambda v: luhn(value[0] + v) == luhn(value))
    if kind == "ip":
        x = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in value.split("."))))
        net = next((n for n in NETWORKS if x >> 32 - n.prefixlen == int(n.network_address) >> 32 - n.prefixlen), None)
        if net:  # another host of the same special network
            return str(net[cipher.move(f"{label}{net}".encode(), x - int(net.network_address), net.num_addresses)])
        while True:
            x = cipher.move(label.encode(), x, 1 << 32)
            if not any(x >> 32 - n.prefixlen == int(n.network_address) >> 32 - n.prefixlen for n in NETWORKS):
                return str(ipaddress.IPv4Address(x))
    if kind == "ipv6":  # another host below the same sixteen bits
        top, low = divmod(int(ipaddress.IPv6Address(value)), 1 << _HOST_BITS)
        return str(ipaddress.IPv6Address(top << _HOST_BITS | cipher.move(f"{label}{top}".encode(), low, 1 << _HOST_BITS)))
    if kind == "iban":
        body = _walked(value[4:], spell, lambda v: True)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return cipher.spell(label, value, ["0123456789abcdef"] * len(value))
    if kind.startswith("given") and value in _POOL:
        key, k = _POOL[value]
        names = GIVEN[key]
        return names[cipher.move(f"{label}{key}".encode(), k, len(names))].lower()
    if kind == "surname" or kind.startswith("given"):
        alphabets = [CLASSES[_CLASS[c]] if c in _CLASS else "" for c in value]
        return _walked(value, lambda v: cipher.spell(label, v, alphabets), lambda v: kind == "surname" or v not in _POOL)
    return spell(value)


def _mask(text: str) -> str:
    return "".join("0" if c in _DIGITS else "a" if c in _LOWER else "A" if c in _UPPER else c for c in text)


def space(kind: str, value: str) -> tuple[str, int]:
    """The closed set that holds a canonical value and its surrogates: its name, and about how many values it has."""
    size = lambda v: math.prod(len(a) for a in _plain(v) if a)
    if kind == "email":
        local, _, domain = value.partition("@")
        if any(domain == d or domain.endswith("." + d) for d in PUBLIC_DOMAINS):
            return f"email {_mask(local)}@{domain}", size(local)
        own, _, top = domain.rpartition(".")
        return f"email {_mask(local)}@{_mask(own)}.{top}", size(local) * size(own)
    if kind == "phone":
        low = value[0] in "01"
        return f"phone {len(value)} {low}", (2 if low else 8) * 10 ** (len(value) - 1)
    if kind == "card":
        good = luhn(value)
        return f"card {value[0]} {len(value)} {good}", (1 if good else 9) * 10 ** (len(value) - 2)
    if kind == "ip":
        x = ipaddress.IPv4Address(".".join(str(int(p)) for p in value.split(".")))
        net = next((n for n in NETWORKS if x in n), None)
        return f"ip {net}", net.num_addresses if net else (1 << 32) - sum(n.num_addresses for n in NETWORKS)
    if kind == "ipv6":
        return f"ipv6 {int(ipaddress.IPv6Address(value)) >> _HOST_BITS}", 1 << _HOST_BITS
    if kind == "iban":
        return f"iban {value[:2]} {_mask(value[4:])}", size(value[4:])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return f"secret {len(value)}", 16 ** len(value)
    if kind.startswith("given") and value in _POOL:
        key = _POOL[value][0]
        return f"{kind} {key}", len(GIVEN[key])
    if kind == "surname" or kind.startswith("given"):
        return f"{kind} {[_CLASS.get(c, c) for c in value]}", math.prod(len(CLASSES[_CLASS[c]]) for c in value if c in _CLASS)
    return f"{kind} {_mask(value)}", size(value)


def dressed(kind: str, value: str, new: str) -> str:
    """The surrogate in the mention's own punctuation and case."""
    if kind in ("phone", "card", "ssn"):
        digits = [k for k, c in enumerate(value) if c.isdigit()][-len(new) :]
        out = list(value)
        for k, c in zip(digits, new, strict=True):
            out[k] = c
        return "".join(out)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in value)
    if kind == "email" and len(new) == len(value):
        return "".join(n.upper() if v.isupper() else n for v, n in zip(value, new, strict=True))
    if kind == "ipv6":
        return new.upper() if value.isupper() else new
    if kind == "surname" or kind.startswith("given"):
        return new.upper() if value.isupper() else "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    return new


def replaced(text: str | None, cipher: Cipher, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, end) of what was replaced in the original."""
    found = detect(text)
    if not found:
        return text, []
    out, at = [], 0
    for lo, hi, kind in found:
        value = text[lo:hi]
        name = canonical(kind, value)
        out += [text[at:lo], dressed(kind, value, surrogate(cipher, kind, name, attempts.get((kind, name), 0)))]
        at = hi
    return "".join([*out, text[at:]]), [(kind, lo, hi) for lo, hi, kind in found]


def entities(docs: DataFrame) -> DataFrame:
    """(doc, kind, value) for each document's different entities, in canonical form. docs: (doc, text)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, v) for d, t in zip(b["doc"], b["text"], strict=True) if isinstance(t, str) for k, v in sorted({(kind, canonical(kind, t[lo:hi])) for lo, hi, kind in detect(t)})]
            yield pd.DataFrame(rows, columns=["doc", "kind", "value"])

    return docs.where("doc IS NOT NULL").mapInPandas(find, "doc long, kind string, value string")


def tries(found: DataFrame, key: bytes, limit: int = 64) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate won't do. found: different (kind, value), materialised.

    A surrogate must be no entity of the corpus, and of one entity only; where several ask for the
    same, the smallest value keeps it. The others try again under another permutation. Where a
    crowded space (given names, very short values) has no such assignment, or limit rounds find none,
    all entities of the space keep the first permutation, which alone makes surrogates distinct and
    none its own. A round leaves at most about half of what the one before left.
    """
    cipher = Cipher(key)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, v, *space(k, v)) for k, v in zip(b["kind"], b["value"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[3] < LARGE], columns=["kind", "value", "space", "size"])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(new=[surrogate(cipher, k, v, a) for k, v, a in zip(b["kind"], b["value"], b["attempt"], strict=True)])

    placed = found.mapInPandas(place, "kind string, value string, space string, size long")
    full = placed.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where(F.col("n") * CROWDED > F.col("size"))
    crowded = placed.join(full.select("space"), "space", "left_semi").select("kind", "value", F.lit(True).alias("crowded"))
    now = found.join(crowded, ["kind", "value"], "left").select("kind", "value", F.lit(0).alias("attempt"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    taken = found.select("kind", F.col("value").alias("new"))
    rounds = 0
    while True:
        rounds += 1
        made = cut(now.mapInPandas(make, "kind string, value string, attempt int, crowded boolean, new string"))
        free = made.where("NOT crowded")
        real = free.join(taken, ["kind", "new"], "left_semi").select("kind", "value")
        twice = made.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(~F.col("crowded"), "value"))["value"].alias("keeper")).where("n > 1")
        shared = free.join(twice.select("kind", "new", "keeper"), ["kind", "new"]).where("value != keeper").select("kind", "value")
        again = cut(real.union(shared).distinct())
        if again.isEmpty():
            return made.where("attempt > 0").select("kind", "value", "attempt")
        now = made.join(again.withColumn("bad", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt"), "crowded")
        if rounds % limit == 0:  # spaces without an assignment count as crowded; larger ones go on
            spaces = placed.join(again, ["kind", "value"], "left_semi").select("space").distinct()
            given_up = placed.join(spaces, "space", "left_semi").select("kind", "value", F.lit(True).alias("late"))
            late = F.coalesce("late", F.lit(False))
            now = now.join(given_up, ["kind", "value"], "left").select("kind", "value", F.when(late, 0).otherwise(F.col("attempt")).alias("attempt"), (F.col("crowded") | late).alias("crowded"))


#: The setting that holds the secret key of op4_pii.
KEY = "spark.vektorium.surrogateKey"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name; where they name none, a random one that holds as long as the session."""
    held = spark.conf.get(KEY, None)
    if not held:
        held = secrets.token_hex(32)
        spark.conf.set(KEY, held)
    return held.encode()


def pseudonymised(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, key: bytes) -> DataFrame:
    """docs with ``__v_pii``: the text with surrogates, and the kind, start and end of each replaced entity.

    The key, a secret, decides all surrogates, so an entity has one wherever it occurs, and two entities never
    share one. Digits, letters' case, punctuation, script, card brand and checksums, address class,
    mail domains of public providers and a name's gender stay as they were. Null texts stay null,
    texts without entities as they are; rows with a null id are rewritten, but their entities don't
    take part in the collision checks; repeated rows get equal results, an empty table stays empty,
    texts of any length are read whole.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    found = cut(entities(own))
    odd = tries(cut(found.select("kind", "value").distinct()), key)
    by_doc = cut(found.join(odd, ["kind", "value"]).groupBy("doc").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("__v_tries"))).withColumnRenamed("doc", "__v_doc")
    side = F.broadcast(by_doc) if is_small(by_doc, 32 + 64 * F.size("__v_tries")) else by_doc
    cipher = Cipher(key)

    @F.pandas_udf("text string, entities array<struct<kind:string,start:int,end:int>>")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, attempts in batches:
            rows = [replaced(t if isinstance(t, str) else None, cipher, {} if a is None else {(x["kind"], x["value"]): x["attempt"] for x in a}) for t, a in zip(texts, attempts, strict=True)]
            yield pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "entities": pd.Series([r[1] for r in rows], dtype=object)})

    joined = docs.join(side, docs[id_col] == side["__v_doc"], "left")
    return joined.withColumn("__v_pii", rewrite(F.col(text), F.col("__v_tries"))).drop("__v_doc", "__v_tries")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark))
    kinds: Column = F.array_sort(F.array_distinct(F.transform("__v_pii.entities", lambda e: e["kind"])))
    return found.select("doc_id", F.col("__v_pii.text").alias("text"), F.size("__v_pii.entities").cast("long").alias("n_entities"), kinds.alias("kinds"))
