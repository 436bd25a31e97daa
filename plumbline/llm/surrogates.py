"""PII surrogates: keyed, format-preserving and type-consistent replacements.

Each entity is read as a number in the space of its own format (digits for digits, letters of the same alphabet for
letters, a given name for one of the same gender and script, an address of the same network class) and moved by a keyed
permutation of that space. A permutation never gives two entities of one format the same surrogate, whatever the size of the
corpus, and equal entities get equal ones in every document, so distinctness and coreference hold without a shared table.
A distributed check over the entities of all documents confirms this, and that no surrogate is its own original; should it
fail, the next key version is taken.

Letter case follows the occurrence and does not tell entities apart. Card numbers keep whether their check digit holds, account
numbers their country and valid check digits. Persons are runs of capitalised words that `persons` has learned from the corpus to be names,
and names after titles, listed given names and cue words (these unless the corpus tells that they are none), with up to three
words, and later bare mentions of a surname so found. Defined
cases: a null text stays null; empty texts stay; repeated rows give repeated results; a null id is carried through. Spans
are code points of the original, end exclusive. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import persons as learned
from .common import lean, slices, string_batch

KINDS = ("email", "phone", "card", "ip", "person", "id")
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "alice anna beatrice clara diana elena emma julia laura maria nora sofia".split(),
    ("latin", "m"): "adam albert carl daniel david felix hugo john louis martin peter thomas".split(),
    ("cyrillic", "f"): "анна вера галина елена ирина мария нина ольга".split(),
    ("cyrillic", "m"): "алексей борис виктор иван михаил олег павел сергей".split(),
}
#: Titles and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": ""}
#: Alphabets; letters move inside their own.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω")
#: Further letters by code point range (Han, Hangul, kana, Arabic, Hebrew, Devanagari).
RANGES = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x0621, 0x063A), (0x05D0, 0x05EA), (0x0905, 0x0939))
_PLACE = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
_SIZE = [*map(len, ALPHABETS), *(b - a + 1 for a, b in RANGES)]


def _place(c: str) -> tuple[int, int] | None:
    """(alphabet, index) of a sign that moves."""
    if (known := _PLACE.get(c)) or ord(c) < 0x0591:
        return known
    return next(((len(ALPHABETS) + k, ord(c) - a) for k, (a, b) in enumerate(RANGES) if a <= ord(c) <= b), None)


def _sign(alphabet: int, i: int) -> str:
    return ALPHABETS[alphabet][i] if alphabet < len(ALPHABETS) else chr(RANGES[alphabet - len(ALPHABETS)][0] + i)

#: Words after which two or three capitalised words are a person.
CUES = ("contact", "met", "dear", "signed", "signed by", "author", "written by", "spoke with", "spoke to", "ask for", "name", "name is", "regards", "sincerely", "kontakt", "gezeichnet", "signé", "contactez", "контакт", "автор")
#: Words that join one person to the next.
JOINED = ("and", "or", "with", "about", "und", "oder", "et", "y", "и")

AT = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
LOCAL = re.compile(r"[\w.%+-]")
PHONE = re.compile(
    r"(?<![\w+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{3,4}(?!\w)|(?<![\w+.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])"
    r"|(?<![\w.+-])\d{3}\.\d{3}\.\d{4}(?![\w-]|\.\d)|(?<![\w.+-])0\d{1,4} \d{3,4} \d{3,4}(?![\w-]| \d)|(?<![\w.+-])0\d{1,4}[/-]\d{5,8}(?![\w-])"
)
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}|:)(?![\w:.])|(?<![\w:.])[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}(?![\w:.])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
NATIONAL = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_NAMES = "|".join(n.capitalize() for names in GIVEN.values() for n in names)
_WORD = r"[^\W\d_][\w'-]*"
_LEAD = "|".join(rf"{c[0].upper()}{c[1:]}|{c}" for c in CUES)
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.?\s+({_WORD})(?:\s+({_WORD}))?(?:\s+({_WORD}))?")
GIVEN_NAME = re.compile(rf"\b({_NAMES})(?:\s+({_WORD}))?(?:\s+({_WORD}))?")
CUED = re.compile(rf"\b(?:{_LEAD})[:,]?\s+(?={_WORD}\s)")
PAIR = re.compile(rf"({_WORD})\s+({_WORD})(?:\s+({_WORD}))?")
NEXT = re.compile(rf",?\s+(?:{'|'.join(JOINED)})\s+")
_GAP = r"[.:,\s\p{Z}\x0b\x1c-\x1f\x{85}]"
#: A text without this has no entity: a linear-time prefilter. It knows the same white space and digits as the patterns.
HINT = rf"@|\p{{Nd}}(?:[ ./()+-]{{0,3}}\p{{Nd}}){{6}}|\p{{Nd}}\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}\.\p{{Nd}}|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|(?:{'|'.join(TITLES)}){_GAP}|{_NAMES}|(?:{_LEAD}){_GAP}"


class Keyed:
    """Keyed permutations of number ranges."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, k: int, x: int, size: int) -> int:
        data = f"{tweak}|{k}|{x}".encode()
        need = (size.bit_length() + 64) // 8 + 1
        digest = hashlib.shake_256(self.key + b"|" + data).digest(need)
        return int.from_bytes(digest, "big") % size

    def permute(self, x: int, size: int, tweak: str) -> int:
        """The place of x in a permutation of range(size): a keyed shift for small ranges (no fixed point), a Feistel network with cycle walking for others."""
        if size < 2:
            return x
        if size < 4096:
            return (x + 1 + self._round(tweak, 0, size, size - 1)) % size
        a = isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, a)
            for k in range(0, 8, 2):
                left = (left + self._round(tweak, k, right, a)) % a
                right = (right + self._round(tweak, k + 1, left, a)) % a
            x = left * a + right
            if x < size:
                return x

    def word(self, text: str, tweak: str) -> str:
        """A lower-case text with every digit and known letter moved together; other signs stay. A text of other signs only becomes a hexadecimal name."""
        spots = [_place(c) for c in text]
        x, size = 0, 1
        for s in spots:
            if s:
                n = _SIZE[s[0]]
                x, size = x * n + s[1], size * n
        if size < 2:  # no known letter or digit: a name of its own
            return hashlib.shake_256(self.key + f"|{tweak}|{text}".encode()).hexdigest(8)
        shape = "".join(str(s[0]) if s else c for s, c in zip(spots, text, strict=True))
        x = self.permute(x, size, f"{tweak}|{shape}")
        out = []
        for s, c in zip(reversed(spots), reversed(text), strict=True):
            if s:
                x, i = divmod(x, _SIZE[s[0]])
                c = _sign(s[0], i)
            out.append(c)
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that belongs after the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_number(text: str) -> int:
    """The number whose remainder by 97 tells whether check digits hold: letters count from 10."""
    return int("".join(str(int(c, 36)) for c in text))


def _refill(pattern: str, signs: str) -> str:
    it = iter(signs)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def script(name: str) -> str:
    return "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in name.lower()) else "latin"


class Surrogates:
    """Surrogates of canonical entities under one key."""

    def __init__(self, key: bytes):
        self.keyed = Keyed(key)
        self.of = lru_cache(1 << 16)(self._of)

    def _of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, host = value.partition("@")
            first, dot, rest = host.partition(".")
            moved = self.keyed.word(f"{local}@{first}", f"email|{rest}")
            return f"{moved}{dot}{rest}"
        if kind == "phone":
            lead = re.match(r"\+\d{1,3}(?=[ (-])", value)
            head = lead.group() if lead else ""
            return head + self.keyed.word(value[len(head) :], f"phone|{head}")
        if kind == "card":
            shift = (int(value[-1]) - luhn(value[:-1])) % 10
            body = self.keyed.word(value[:-1], f"card|{shift}")
            return body + str((luhn(body) + shift) % 10)
        if kind == "ip":
            return self._ip(value)
        if kind == "iban":
            body = self.keyed.word(value[4:].lower(), f"iban|{value[:2]}").upper()
            return f"{value[:2]}{98 - iban_number(body + value[:2] + '00') % 97:02d}{body}"
        if kind == "given":
            for (kind_, gender), names in GIVEN.items():
                if value in names:
                    return names[self.keyed.permute(names.index(value), len(names), f"given|{kind_}|{gender}")]
        return self.keyed.word(value, kind)

    def _ip(self, value: str) -> str:
        if ":" in value:  # the first group, and with it the kind of address, stays
            x = int(ipaddress.IPv6Address(value))
            return str(ipaddress.IPv6Address((x >> 112 << 112) + self.keyed.permute(x & (1 << 112) - 1, 1 << 112, f"ip6|{x >> 112}")))
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return self.keyed.word(value, "ip")
        x = int.from_bytes(bytes(parts), "big")
        for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"):
            n = ipaddress.ip_network(net)
            base = int(n.network_address)
            if base <= x < base + n.num_addresses:
                return str(ipaddress.ip_address(base + self.keyed.permute(x - base, n.num_addresses, net)))
        while True:  # cycle walking stays inside the other addresses
            x = self.keyed.permute(x, 1 << 32, "public")
            if not any(ipaddress.ip_address(x) in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")):
                return str(ipaddress.ip_address(x))


def recase(model: str, text: str) -> str:
    """text in the letter case of model, place by place."""
    return "".join(c.upper() if m.isupper() else c for m, c in zip(model, text, strict=True)) if len(model) == len(text) else (text.upper() if model.isupper() else text.capitalize() if model[:1].isupper() else text)


def canonical(kind: str, value: str) -> str:
    if kind == "card":
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip" and ":" in value:
        return str(ipaddress.IPv6Address(value))
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value.lower()


def emails(text: str):
    """Spans of e-mail addresses, read from each @ outwards, so that long runs without one cost nothing more."""
    last = 0
    for m in AT.finditer(text):
        s = m.start()
        while s > last and LOCAL.match(text[s - 1]):
            s -= 1
        if s < m.start() and re.match(r"\w", text[m.start() - 1]):
            yield s, m.end()
            last = m.end()


def is_ip6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return "::" in text or text.count(":") == 7


def is_iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and iban_number(t[4:] + t[:4]) % 97 == 1


def _name_like(word: str | None) -> bool:
    """Capitalised, or of a script without capitals."""
    return bool(word) and (word[0].isupper() or word[0].lower() == word[0].upper())


def persons(text: str, names: frozenset[str] = frozenset(), vetoed: frozenset[str] = frozenset()):
    """(start, end, kind) of names: learned ones, after a title, from a listed given name on, after a cue (and what is joined to it) unless vetoed, and every later bare mention of a surname so found."""
    found: dict[tuple[int, int], str] = {}
    listed = {n for names_ in GIVEN.values() for n in names_}

    def take(m: re.Match, at_least: int) -> int:
        """The words of a match that are names, up to the first that is none; the end of the last."""
        n = next((i for i, w in enumerate(m.groups()) if not _name_like(w)), len(m.groups()))
        if n < at_least:
            return 0
        for g in range(1, n + 1):
            span = m.span(g)
            kind = "given" if g == 1 and m.group(g).lower() in listed else "surname"
            found.setdefault(span, kind)
        return m.end(n)

    told = {}
    for s, e, *_ in learned.runs(text, set(TITLES)) if names or vetoed else ():
        run = learned.name_of(text[s:e])
        if run in names:
            for k, w in enumerate(re.finditer(r"[^ ]+", run)):
                found[s + w.start(), s + w.end()] = "given" if k == 0 and w.group().lower() in listed else "surname"
        elif run in vetoed:
            told.update({s + w.start(): e for w in re.finditer(r"[^ ]+", run)})
    for m in TITLED.finditer(text):
        take(m, 1)
    for m in GIVEN_NAME.finditer(text):
        take(m, 2)
    for m in CUED.finditer(text):
        at = m.end()
        while (p := PAIR.match(text, at)) and p.group(1)[0].isupper() and p.group(2)[0].isupper():
            if (over := told.get(p.start())) and (p.start(), p.end(1)) not in found:
                end = over
            elif not (end := take(p, 2)):
                break
            if not (n := NEXT.match(text, end)):
                break
            at = n.end()
    bare = {text[s:e] for (s, e), kind in found.items() if kind == "surname" and e - s >= 3 and text[s].isupper()}
    if bare:
        for m in re.finditer(_WORD, text):
            if m.group() in bare or m.group().endswith("'s") and m.group()[:-2] in bare:
                found.setdefault((m.start(), m.end() - 2 * m.group().endswith("'s")), "surname")
    return [(s, e, kind) for (s, e), kind in sorted(found.items())]


def entities(text: str, names: frozenset[str] = frozenset(), vetoed: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities in order; of overlapping ones the first kind in the list wins."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def add(s: int, e: int, kind: str) -> None:
        if not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            found.append((s, e, kind))

    for s, e in emails(text):
        add(s, e, "email")
    for kind, pattern, good in (("iban", IBAN, is_iban), ("ip", IP, None), ("ip", IP6, is_ip6), ("national", NATIONAL, None), ("phone", PHONE, None), ("card", CARD, None)):
        for m in pattern.finditer(text):
            if good is None or good(m.group()):
                add(*m.span(), kind)
    for s, e, kind in persons(text, names, vetoed):
        add(s, e, kind)
    return sorted(found)


def replaced(text: str, spans: list[tuple[int, int, str]], names: Surrogates) -> str:
    out, last = [], 0
    for s, e, kind in spans:
        old = text[s:e]
        new = names.of(kind, canonical(kind, old))
        out += [text[last:s], _refill(old, new) if kind in ("card", "iban") else recase(old, new) if kind != "ip" else new]
        last = e
    return "".join([*out, text[last:]])


def _kind(kind: str) -> str:
    return {"given": "person", "surname": "person", "iban": "id", "national": "id"}.get(kind, kind)


LEARNED = ("names", "vetoed")
ENTITY = pa.schema([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])


def marked(part: pa.RecordBatch):
    """(row, text, entities) of the rows that may have some; learned runs come in the columns names and vetoed where there are any."""
    column = part.column("text")
    may = pc.match_substring_regex(pc.fill_null(column, ""), HINT).to_numpy(zero_copy_only=False)
    has = "names" in part.schema.names
    if has:
        may = may | (pc.fill_null(pc.list_value_length(part.column("names")), 0).to_numpy(zero_copy_only=False) > 0)
    for i in map(int, np.flatnonzero(may)):
        t = column[i].as_py()
        known = [frozenset(part.column(c)[i].as_py() or ()) for c in ("names", "vetoed")] if has else []
        yield i, t, entities(t, *known)


def entity_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, original, surrogate): every different entity of all texts, by canonical value."""

    def run(batches):
        names = Surrogates(key)
        for batch in batches:
            seen = set()
            for part in slices(batch, "text", 8 << 20):
                for _, t, found in marked(part):
                    seen.update((k, canonical(k, t[s:e])) for s, e, k in found)
            rows = sorted(seen)
            yield string_batch(ENTITY, kind=[k for k, _ in rows], original=[v for _, v in rows], surrogate=[names.of(k, v) for k, v in rows])

    return docs.select("text", *(c for c in LEARNED if c in docs.columns)).mapInArrow(lean(run), "kind string, original string, surrogate string").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that two entities share, or that are their own original."""
    shared = table.groupBy("kind", "surrogate").agg(F.min("original").alias("low"), F.max("original").alias("high")).where(F.col("low") != F.col("high"))
    own = table.where(F.col("original") == F.col("surrogate")).select("kind", "surrogate", F.col("original").alias("low"), F.col("original").alias("high"))
    return shared.unionByName(own)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("spans", pa.string()), ("text", pa.string())])


def pseudonymised(docs: DataFrame, secret: str, versions: int = 5) -> DataFrame:
    """(doc_id, counts per kind, spans, text with surrogates) of each row of (doc_id, text)."""
    docs = learned.with_names(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), set(TITLES), [n for names in GIVEN.values() for n in names])
    for version in range(versions):
        key = hashlib.sha256(f"{secret}|{version}".encode()).digest()
        if not collisions(entity_table(docs, key)).limit(1).count():
            break
    else:
        raise RuntimeError("no key version without collisions")

    def run(batches):
        names = Surrogates(key)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                column = part.column("text")
                counts = np.zeros((len(KINDS), part.num_rows), np.int64)
                spans, changed = [""] * part.num_rows, {}
                for i, t, found in marked(part):
                    if found:
                        for k, n in Counter(_kind(k) for _, _, k in found).items():
                            counts[KINDS.index(k), i] = n
                        spans[i] = ",".join(f"{_kind(k)}:{s}:{e}" for s, e, k in found)
                        changed[i] = replaced(t, found, names)
                if changed:
                    mask = np.zeros(part.num_rows, bool)
                    mask[list(changed)] = True
                    column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(changed.values()), column.type))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(spans), column.cast(pa.string())], schema=SCHEMA)

    return docs.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string, text string")
