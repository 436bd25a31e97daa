"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The suffixes that each version of the name cleaner takes away.
SUFFIXES_V2 = (" Jr.", " Sr.", " III", " II")
SUFFIXES_V3 = r"\s+(jr\.?|sr\.?|ii|iii|iv)$"
SUFFIXES_V4 = r"\b(JR|SR|III|II|IV)\b"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return none_if_empty(F.regexp_extract(c, pattern, group))


def key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def clean_v1(c: Column) -> Column:
    """Lower case, literal dots removed, trimmed."""
    return F.trim(F.replace(F.lower(c), F.lit("."), F.lit("")))


def undouble_tokens(c: Column) -> Column:
    """With three tokens or more and the first equal to the last, the first goes."""
    w = F.split(c, " ")
    return F.when((F.size(w) >= 3) & (F.get(w, F.lit(0)) == F.element_at(w, -1)), F.array_join(F.slice(w, 2, 1_000_000), " ")).otherwise(c)


def clean_v2(c: Column) -> Column:
    """Suffixes removed (the longer numeral first), trimmed, lower case, a doubled first token dropped."""
    for suffix in SUFFIXES_V2:
        c = F.replace(c, F.lit(suffix), F.lit(""))
    return undouble_tokens(F.lower(F.trim(c)))


def clean_v3(c: Column) -> Column:
    """Lower case, a trailing generation suffix dropped, dots removed."""
    return F.replace(F.regexp_replace(F.trim(F.lower(c)), SUFFIXES_V3, ""), F.lit("."), F.lit(""))


def clean_v4(c: Column) -> Column:
    """Upper case, generation words removed, other signs to single spaces."""
    words = F.regexp_replace(F.upper(c), SUFFIXES_V4, "")
    return F.trim(F.regexp_replace(F.regexp_replace(words, r"[^A-Z0-9]+", " "), r" +", " "))


def normalize_suffix(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("Jr."), F.lit("Jr")))


def undouble(c: Column) -> Column:
    """`A BA B` to `A B`: first token equal to the last of three or more; equal halves; equal halves in tokens."""
    w, n = F.split(c, " "), F.length(c)
    half = F.substring(c, F.lit(1), (n / 2).cast("int"))
    left, right = F.slice(w, F.lit(1), F.greatest((F.size(w) / 2).cast("int"), F.lit(1))), F.slice(w, (F.size(w) / 2).cast("int") + 1, F.size(w))
    tokens = (F.size(w) >= 2) & (F.size(w) % 2 == 0) & (left == right)
    return F.when((F.size(w) >= 3) & (F.get(w, F.lit(0)) == F.element_at(w, -1)), F.array_join(F.slice(w, 2, 1_000_000), " ")).when((n > 0) & (n % 2 == 0) & (c == F.concat(half, half)), half).when(tokens, F.array_join(left, " ")).otherwise(c)


def strip_marks(c: Column) -> Column:
    return F.translate(c, "*+", "")


def signature(c: Column) -> Column:
    """An error message with what varies masked: links, hexadecimal numbers, numbers of three digits or more; 200 code points."""
    c = F.regexp_replace(c, r"https?://\S+", "<url>")
    c = F.regexp_replace(c, r"0x[0-9a-fA-F]+", "0x?")
    return F.substring(F.regexp_replace(c, r"\d{3,}", "?"), 1, 200)


def mentions(c: Column, alias_code: dict[str, str]) -> Column:
    """Codes of all aliases in the text, each once in order of appearance; of overlapping aliases the longest counts."""
    aliases = sorted(alias_code, key=lambda a: (-len(a), a))
    pattern = r"(?i)\b(" + "|".join(aliases) + r")\b"
    codes = F.create_map(*[F.lit(x) for a in aliases for x in (a.lower(), alias_code[a])])
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda m: codes[F.lower(m)]))


def any_keyword(c: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(c), F.lower(k)))


def video_id(url: Column) -> Column:
    return F.coalesce(extract(url, r"[?&]v=([A-Za-z0-9_-]{6,})"), extract(url, r"youtu\.be/([A-Za-z0-9_-]{6,})"), extract(url, r"/shorts/([A-Za-z0-9_-]{6,})"))


def label(c: Column, classes: list[str], default: str) -> Column:
    """A class name out of a free answer: exact after normalising, else the first class (in list order) that contains it or is contained in it (four code points at least), else the default."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]", "_"), r"^[.:,;]+|[.:,;]+$", "")
    each = F.array(*map(F.lit, classes))
    near = F.get(F.filter(each, lambda k: (F.length(n) >= 4) & (F.contains(n, k) | F.contains(k, n))), F.lit(0))
    return F.when(F.array_contains(each, n), n).otherwise(F.coalesce(near, F.lit(default)))


def split_multi(c: Column) -> Column:
    """`A, B` to MULTI."""
    return F.when(F.size(F.split(c, r"\s*,\s*")) > 1, F.lit("MULTI")).otherwise(c)
