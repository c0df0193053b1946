"""Ranked and plain search. Each operator is one plan: a filter over every arm, a
first-match score and a top-k, whatever tier a row falls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_fold, begins, contains, equals, page_bounds
from ..session import Session
from .detail import get_class


def paged(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    offset, limit = page_bounds(page, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def nulls_first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def ranked(df: DataFrame, arms: list[tuple[int, str, Column]]) -> DataFrame:
    """``df`` with score and match_reason of the first arm that holds; rows without one go."""
    hit = F.lit(None).cast("struct<score:int,match_reason:string>")
    for score, reason, condition in reversed(arms):
        hit = F.when(condition, F.struct(F.lit(score).alias("score"), F.lit(reason).alias("match_reason"))).otherwise(hit)
    return df.withColumn("__hit", hit).where("__hit is not null").select(*df.columns, "__hit.score", "__hit.match_reason")


def find_class(s: Session, term: str, page: int = 1, size: int = 20) -> DataFrame:
    fqn, simple = F.col("fqn"), F.col("simple_name")
    arms = [
        (100, "exact_fqn", equals(fqn, term)),
        (90, "simple_name", equals(simple, term)),
        (82, "simple_prefix", begins(simple, term)),
        (80, "prefix", begins(fqn, term)),
        (50, "contains", contains(fqn, term)),
    ]
    hits = ranked(s.classes.select("fqn", "simple_name", "package_name", "kind", "shard_id"), arms)
    return s.with_jar(paged(hits, [F.desc("score"), *nulls_first("fqn", "shard_id")], page, size))


def find_method(s: Session, term: str, page: int = 1, size: int = 20) -> DataFrame:
    owner, _, name = term.rpartition(".")
    exact = equals(F.col("symbol"), term)
    if owner and name:
        exact = exact | (equals(F.col("owner"), owner) & equals(F.col("name"), name))
    arms = [
        (100, "exact_method", exact),
        (95, "method_name", equals(F.col("name"), term)),
        (75, "method_prefix", begins(F.col("name"), term)),
        (50, "contains", contains(F.col("name"), term) | contains(F.col("owner"), term)),
    ]
    hits = ranked(s.methods.where("owner_resolved").select(F.col("owner").alias("class_fqn"), "owner", "symbol", "name", "descriptor", "return_fqn", "shard_id"), arms).drop("owner", "symbol")
    return s.with_jar(paged(hits, [F.desc("score"), *nulls_first("class_fqn", "name", "descriptor", "shard_id")], page, size))


#: (score, reason, kind, condition) of a symbol's first match; t is the term, held says whether a field holds it, prefixes are sought for terms of ASCII alone.
SYMBOL_ARMS = [
    (100, "exact_fqn", "class", "name = t"),
    (98, "exact_method", "method", "name = t"),
    (92, "method_name", "method", "substring_index(name, '#', -1) = t"),
    (90, "simple_name", "class", "substring_index(name, '.', -1) = t"),
    (88, "annotation_fqn", "annotation", "name = t"),
    (86, "spi_impl", "spi", "name = t"),
    (86, "spi_key", "spi", "owner = t"),
    (84, "config_property", "config-property", "name = t"),
    (82, "simple_prefix", "class", "prefix and startswith(substring_index(name, '.', -1), t)"),
    (80, "prefix", "class", "prefix and startswith(name, t)"),
    (78, "annotation_prefix", "annotation", "prefix and startswith(name, t)"),
    (76, "spi_prefix", "spi", "prefix and startswith(name, t)"),
    (75, "method_prefix", "method", "prefix and startswith(substring_index(name, '#', -1), t)"),
    (70, "config_prefix", "config-property", "prefix and startswith(name, t)"),
    (65, "string_constant", "string", "name = t"),
    (60, "string_prefix", "string", "prefix and startswith(name, t)"),
    (55, "class_contains", "class", "held"),
    (50, "method_contains", "method", "held"),
    (45, "annotation_contains", "annotation", "held"),
    (44, "spi_contains", "spi", "held"),
    (43, "config-property_contains", "config-property", "held"),
    (30, "string_contains", "string", "held"),
]
_FIRST_ARM = "case " + " ".join(f"when kind = '{k}' and {c} then named_struct('score', {score}, 'match_reason', '{reason}')" for score, reason, k, c in SYMBOL_ARMS) + " end"


def search_symbol(s: Session, term: str, page: int = 1, size: int = 20) -> DataFrame:
    """The ranked union over classes, methods, annotations, services, properties and strings."""
    rows, held = s.index.candidates(term) if s.index else (s.symbols, False)
    names = ["kind", "name", "owner", "detail", "shard_id"]
    anywhere = F.lit(True) if held else contains(F.col("name"), term) | contains(F.col("owner"), term) | contains(F.col("detail"), term)
    asked = rows.select(*names, F.lit(term).alias("t"), F.lit(bool(term) and term.isascii()).alias("prefix"), anywhere.alias("held"))
    hits = asked.select(*names, F.expr(_FIRST_ARM).alias("hit")).where("hit is not null").select(*names, "hit.score", "hit.match_reason")
    return s.with_jar(paged(hits, [F.desc("score"), *nulls_first("kind", "name", "shard_id", "owner", "detail")], page, size))


def find_string(s: Session, text: str) -> DataFrame:
    """Every constant that holds ``text``, with its class and method."""
    classes = s["classes"].select("shard_id", F.col("fqn").alias("class_fqn"))
    if s.index:
        strings = s.index.candidates(text)[0].where("kind = 'string'").select(F.col("name").alias("value"), F.col("owner").alias("class_fqn"), F.col("detail").alias("method"), "shard_id")
    else:
        strings = s["strings"].select("value", "class_fqn", F.concat("method_name", "method_descriptor").alias("method"), "shard_id")
    hits = strings.where(contains(F.col("value"), text)).join(classes, ["shard_id", "class_fqn"])
    return s.with_jar(hits.select("value", "class_fqn", "method", "shard_id"))


def list_packages(s: Session, prefix: str = "") -> DataFrame:
    c = s.classes
    if prefix:
        c = c.where((F.col("package_name") == prefix) | F.startswith(F.lower(F.col("package_name")), F.lit(prefix.lower() + ".")) & F.lit(prefix.isascii()))
    return s.with_jar(c.groupBy("package_name", "shard_id").agg(F.count(F.lit(1)).alias("class_count")))


def open_symbol(s: Session, arg: str) -> DataFrame:
    """The overloads of owner#name. An argument without # is a class, whose details are returned (``detail.get_class``);
    if no shard holds that class, a method search's first page."""
    if "#" in arg:
        hits = s.methods.where("owner_resolved").where(F.col("symbol") == arg)
        return s.with_jar(hits.select("symbol", "descriptor", F.lit(100).alias("score"), F.lit("exact_method").alias("match_reason"), "shard_id"))
    if not s["classes"].where(F.col("fqn") == arg).isEmpty():
        return get_class(s, arg)
    hits = find_method(s, arg)
    return hits.select(F.concat("class_fqn", F.lit("#"), "name").alias("symbol"), "descriptor", "score", "match_reason", "shard_id", "source_jar")


def suggest(names: DataFrame, typed: str, limit: int = 3, most: int = 4) -> DataFrame:
    """Names (name) closest to what was typed, by edit distance."""
    d = F.levenshtein(F.col("name"), F.lit(typed))
    return names.select("name", d.alias("distance")).where(F.col("distance") <= most).distinct().orderBy("distance", "name").limit(limit)


def ngrams(values: DataFrame, column: str, n: int = 3) -> DataFrame:
    """(gram, value): the search index of a column, one row per distinct folded n-gram of a distinct value."""
    folded = ascii_fold(F.col(column))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(folded) - n + 1), lambda i: F.substring(folded, i, F.lit(n))))
    return values.select(column).distinct().where(F.length(folded) >= n).select(F.explode(grams).alias("gram"), F.col(column).alias("value"))


def find_by_ngrams(index: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Values of an index that hold ``text``: those with all of its n-grams, then checked. A text
    shorter than n can't use the index."""
    folded = text.translate(str.maketrans(UPPER, LOWER))
    if len(folded) < n:
        raise ValueError(f"the text has less than {n} characters")
    grams = sorted({folded[i : i + n] for i in range(len(folded) - n + 1)})
    hits = index.where(F.col("gram").isin(grams)).groupBy("value").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(grams))
    return hits.where(contains(F.col("value"), text)).select("value")
