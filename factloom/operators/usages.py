"""Where a project's sources use what a dependency question names.

Terms come from the question and from what it was resolved to. A scan looks at files in order of their paths and stops where its
budgets end: so many files, so many lines. The files' budget is one top-k of paths, whose last is a bound for the scan;
the lines' is the top-k that the answer is, so no file is ranked and nothing is counted twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify, utf8_cut
from ..session import Session
from .provenance import BROAD, CUT_BYTES, HIGH_SIGNAL, precise, provenance, source_lines

#: Files that count as sources, and folders that don't hold any.
EXTENSIONS = ("java", "kt", "kts", "groovy", "scala", "xml", "gradle", "properties", "yml", "yaml")
SKIPPED_FOLDERS = (".git", ".gradle", ".idea", ".mvn", ".settings", ".vscode", "build", "coverage", "dist", "generated", "generated-sources", "generated-test-sources", "node_modules", "out", "target")
FILE_BUDGET, LINES = 2000, 20
#: Origins that give terms, at most.
ORIGINS = 50
BLANK = " \t\n\r\f\x0b"


def artifact_id(coordinate: str | None) -> str:
    parts = (coordinate or "").split(":")
    return parts[1] if len(parts) > 1 else ""


def question_terms(s: Session, text: str, mode: str | None = None) -> tuple[list[str], list[str]]:
    """(high, broad): what to look for, imports and artifact names before mere names."""
    kind, owner, _ = classify(text)
    said, plain = text.strip(), text.strip().removesuffix(";").strip().removeprefix("import ").strip().removeprefix("static ").strip()
    found = precise(s, text, mode).drop("source_jar").join(s["shards"].select("shard_id", "coordinate", "filename"), "shard_id", "left").orderBy("shard_id", "owner", "reason").limit(ORIGINS).collect()
    high, broad = [said] if said.startswith("import ") else [], [said, plain]
    if kind == "package_import":
        high.append(f"import {owner}.*")
        broad += [owner, f"import {owner}.*"]
    elif kind == "artifact" or mode == "artifact":
        high += [plain, artifact_id(plain)]
        broad += [plain, artifact_id(plain)]
    elif owner:
        high += [f"import {owner}", f"import static {owner}."]
        broad += [owner, f"import {owner}", owner.rpartition(".")[2]]
    for r in found:
        fqn = r["owner"] if r["reason"] in ("exact_fqn", "simple_name") else ""
        jar = [r["coordinate"], (r["filename"] or "").rpartition("/")[2], artifact_id(r["coordinate"])]
        high += [f"import {fqn}", f"import static {fqn}.", *jar] if fqn else jar
        broad += [fqn, fqn.rpartition(".")[2], f"import {fqn}", *jar] if fqn else jar
    unique = lambda terms: list(dict.fromkeys(t for t in terms if t))
    return unique(high), unique(broad)


def project_files(files: DataFrame) -> DataFrame:
    """The files (path, text) that count as sources."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return files.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))


def first_of(terms: list[str], tag: int):
    """The first term that the line holds, with its phase; null if none."""
    hit = F.lit(None).cast("struct<term:string,phase:int>")
    for term in reversed(terms):
        hit = F.when(F.contains("text", F.lit(term)), F.struct(F.lit(term).alias("term"), F.lit(tag).alias("phase"))).otherwise(hit)
    return hit


def scan(files: DataFrame, high: list[str], broad: list[str], limit: int = LINES, file_budget: int = FILE_BUDGET) -> DataFrame:
    """(path, line, term, phase, text, has_more, truncated_reason): lines of source files (path, text) that hold a term, at most ``limit``.

    All files are looked through for terms of high signal first, then for broad ones, each time in order of their paths; files that are too large or hold a NUL count, but aren't read. Both passes share
    ``file_budget``: where it ends before ``limit`` lines and one more are found, truncated_reason is file_budget, and what comes later isn't looked at. A line counts once."""
    kept = project_files(files)
    first = [r["path"] for r in kept.select("path").orderBy("path").limit(file_budget + 1).collect()]
    seen = len(first) if high else 0  # files that the first pass visits
    bounds = [first[:file_budget][-1:] if high else [], first[: max(0, file_budget - seen)][-1:] if broad else []]
    exceeded = bool(high) and len(first) > file_budget or bool(broad) and len(first) > file_budget - seen
    lines = kept.where(F.col("path") <= F.lit(max((b[0] for b in bounds if b), default="")))
    terms = [*high, *broad]
    any_term = "|".join(re.escape(t) for t in terms) or "(?!)"
    lines = source_lines(lines.where(F.col("text").rlike(any_term)), F.col("path"), F.col("text"))
    within = lambda bound: F.col("path") <= F.lit(bound[0]) if bound else F.lit(False)
    hit = F.coalesce(F.when(within(bounds[0]), first_of(high, HIGH_SIGNAL)), F.when(within(bounds[1]), first_of(broad, BROAD)))
    hits = lines.where(F.col("text").rlike(any_term)).withColumn("hit", hit).where("hit is not null").select("path", "line", "hit.term", "hit.phase", utf8_cut(F.trim(F.col("text"), F.lit(BLANK)), CUT_BYTES).alias("text"))
    top = hits.orderBy("phase", "path", "line").limit(limit + 1)
    more = F.count(F.lit(1)).over(Window.partitionBy()) > limit  # over the answer alone
    place = F.row_number().over(Window.orderBy("phase", "path", "line"))
    reason = F.when(~F.col("has_more") & F.lit(exceeded), "file_budget").otherwise("")
    return top.withColumns({"has_more": more, "place": place}).withColumn("truncated_reason", reason).where(F.col("place") <= limit).drop("place")


def answer(s: Session, files: DataFrame, text: str, mode: str | None = None, limit: int = LINES, file_budget: int = FILE_BUDGET) -> dict[str, DataFrame]:
    """A dependency question answered: what it means, why that is on the classpath, where the sources use it."""
    high, broad = question_terms(s, text, mode)
    return {"origins": precise(s, text, mode), "dependencies": provenance(s, text, mode), "usages": scan(files, high, broad, limit, file_budget)}
