"""Text rules that the search operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z lowered and nothing else; what follows a NUL is out of reach of matching."""
    return F.translate(F.substring_index(c, "\0", 1), UPPER, LOWER)


def contains(c: Column, term: str) -> Column:
    """Substring search without regard to ASCII case; false for null."""
    return F.coalesce(F.contains(ascii_fold(c), F.lit(term.translate(str.maketrans(UPPER, LOWER)))), F.lit(False))


def begins(c: Column, term: str) -> Column:
    """Case-sensitive prefix search, for terms of ASCII characters only."""
    return F.coalesce(c.startswith(term), F.lit(False)) if term and term.isascii() else F.lit(False)


def equals(c: Column, term: str) -> Column:
    return F.coalesce(c == term, F.lit(False))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_name(fqn: Column) -> Column:
    """What stands before the last dot; empty if there is none."""
    return F.regexp_extract(fqn, r"(?s)^(.*)[.][^.]*$", 1)


def utf8_cut(c: Column, n: int) -> Column:
    """At most n bytes of UTF-8, not cutting a character in two."""
    return F.when(F.octet_length(c) <= n, c).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string")), "�+$", ""))


def split_coordinate(text: str) -> tuple[str, str, str] | None:
    """(group, artifact, version) of g:a, g:a:v, g:a:type:v or g:a:type:classifier:v."""
    parts = text.split(":")
    if not 2 <= len(parts) <= 6 or not all(p.strip() for p in parts[:2]):
        return None
    version = "" if len(parts) == 2 else parts[2] if len(parts) == 3 else parts[3] if len(parts) == 4 else parts[4]
    return parts[0], parts[1], version


def classify(text: str) -> tuple[str, str, str]:
    """What a dependency question is about: (kind, owner, member)."""
    said = text.strip().removesuffix(";").strip()
    t = said.removeprefix("import ").strip()
    static = t.startswith("static ")
    t = t.removeprefix("static ").strip()
    if not t:
        return "unknown", "", ""
    if t.endswith(".*"):
        return "package_import", t[:-2], ""
    if static:
        owner, _, member = t.rpartition(".")
        return "static_import", owner, member
    if "#" in t:
        owner, _, member = t.partition("#")
        return "method", owner, member
    if ":" in t or t.endswith(".jar"):
        return "artifact", t, ""
    return "import" if said.startswith("import ") else "class", t, ""


def binary_names(fqn: str) -> list[str]:
    """Names that a source name may have in bytecode: a.B.C, a.B$C, ..."""
    out, parts = [fqn], fqn.split(".")
    for k in range(len(parts) - 1, 0, -1):
        if not parts[k - 1][:1].isupper():
            break
        out.append(".".join(parts[:k]) + "$" + "$".join(parts[k:]))
    return out


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, limit) of a page from 1 on; a page has at most 1,000 rows, a window 100,000."""
    if page < 1 or not 1 <= size <= 1000:
        raise ValueError("page starts at 1 and page_size is 1 to 1000")
    if page * size > 100_000:
        raise ValueError("the window ends at row 100,000")
    return (page - 1) * size, size


def parse_size(text: str) -> int:
    """Bytes of 123, 500K, 500M or 2G, in either case."""
    t = text.strip().upper()
    shift = {"K": 10, "M": 20, "G": 30}.get(t[-1:], 0)
    number = (t[:-1] if shift else t).strip()
    if not (number.isascii() and number.isdigit()):
        raise ValueError(f"{text!r} isn't a size such as 500M or 2G")
    return int(number) << shift


def parse_age(text: str) -> int:
    """Hours of 30d or 12h."""
    t = text.strip().lower()
    hours = {"d": 24, "h": 1}.get(t[-1:])
    if hours is None or not (t[:-1].isascii() and t[:-1].isdigit()):
        raise ValueError(f"{text!r} isn't an age such as 30d or 12h")
    return int(t[:-1]) * hours
