"""Quality rules: a table of thresholds compiled into one projection.

A rule names a metric and the least and greatest value that a kept document may
have. ``compile_rules`` turns the table into Boolean columns over the metrics of
``measured``; all of it is built-in expressions over the row's own text, so a plan
is a scan and a projection without a shuffle, whatever the size of the input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, let, table, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Percent of a text's words that may stand in repeated windows.
MAX_REPEAT_PERCENT = 20
#: Frequent function words of the corpus' languages.
STOP_WORDS = (
    "the of and to a in is it that for was on are as with be by this or an he at from not you"
    " de la le et les des un que en qui dans pour sur est pas au"
    " el los y se con por una las del para su al lo como es"
    " der die und den von zu das mit ist im für auf nicht ein eine"
).split()
STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


class Rule(NamedTuple):
    name: str
    metric: str
    least: float | None
    most: float | None


#: Ratios are per word, but for dup_lines: per line that has a word. One stop word
#: is added to those found, so a short text without any passes.
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("exclamations", "exclamation_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.5),
)


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words that stand in an n-word window which the text holds twice or more.

    Windows are sorted by hash; neighbours with equal hashes are compared word
    by word. Texts without equal hashes, most of them, skip the sort.
    """
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def marked(by_hash: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, n) == F.slice(words, b["i"] + 1, n))
        twice = F.filter(by_hash, lambda x, k: F.coalesce(same(F.get(by_hash, k - 1), x), F.lit(False)) | F.coalesce(same(x, F.get(by_hash, k + 1)), F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        reach = lambda p: F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n))))
        return let(places, lambda p: F.aggregate(reach(p), F.lit(0).cast("long"), lambda s, x: s + x))

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), marked))

    return let(hashes, counted)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__m``, a struct of the counts and ratios of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SEPARATORS)) != "")
    first = F.struct(
        word_array(F.col(text_col)).alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )

    def counts(m: Column) -> Column:
        w = m["words"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["n_exclamations"].alias("n_exclamations"),
            F.size(m["lines"]).cast("long").alias("n_lines"),
            (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
            let(w, repeated_words).alias("n_repeat_words"),
        )

    def ratios(c: Column) -> Column:
        per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
        return F.struct(
            c.alias("counts"),
            per("word_chars", "n_words").alias("mean_word_length"),
            per("n_symbols", "n_words").alias("symbol_ratio"),
            per("n_exclamations", "n_words").alias("exclamation_ratio"),
            F.when(c["n_words"] > 0, (c["n_stop_words"] + 1) / c["n_words"]).otherwise(F.lit(0.0)).alias("stop_word_ratio"),
            per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        )

    return docs.withColumn("__m", let(let(first, counts), ratios))


def base_failed() -> Column:
    c = F.col("__m.counts")
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def compile_rules(rules: tuple = RULES) -> dict[str, Column]:
    """Per rule the condition that a kept document meets."""
    out = {}
    for r in rules:
        value, ok = F.col(f"__m.{r.metric}"), F.lit(True)
        if r.least is not None:
            ok = ok & (value >= r.least)
        if r.most is not None:
            ok = ok & (value <= r.most)
        out[r.name] = ok
    return out


def judge(docs: DataFrame, rules: tuple = RULES, text_col: str = "text") -> DataFrame:
    """``docs``' doc_id with the counts, base_failed, kept and the names of the rules that failed.

    A null text is an empty one: no words, base_failed. One row per row, repeats
    and null ids included; other columns aren't read.
    """
    ok = compile_rules(rules)
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    failed = F.array_join(F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in ok.items()]), lambda x: x.isNotNull()), ",")
    c = [F.col(f"__m.counts.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured(docs.select("doc_id", text_col), text_col).select("doc_id", *c, base_failed().alias("base_failed"), (~base_failed() & every).alias("kept"), failed.alias("failed_rules"))


def apply(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    every = ~base_failed()
    for c in compile_rules(rules).values():
        every = every & c
    return measured(docs).where(every).drop("__m")


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_FORMS)
OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT r, i, words[i] AS word, words[i : i + 4] AS five, len(words) AS n FROM d, unnest(range(1, len(words) + 1)) t(i)
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM w WHERE i <= n - 4
), s AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM g, unnest(range(i, i + 5)) t(j) WHERE c > 1 GROUP BY r
), k AS (
  SELECT r, count(*) AS n_stop_words FROM w WHERE word IN ({_STOPS}) GROUP BY r
), m AS (
  SELECT d.r, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words
  FROM d LEFT JOIN s USING (r) LEFT JOIN k USING (r)
), q AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         concat_ws(',', {{rules}}) AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM q
"""
_METRIC_SQL = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "exclamation_ratio": ("n_exclamations", "n_words"),
    "stop_word_ratio": ("(n_stop_words + 1)", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def _rule_sql(r: Rule) -> str:
    a, b = _METRIC_SQL[r.metric]
    x = f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b}::DOUBLE ELSE 0 END)"
    bad = " OR ".join([f"{x} < {r.least}"] * (r.least is not None) + [f"{x} > {r.most}"] * (r.most is not None))
    return f"CASE WHEN {bad} THEN '{r.name}' END"


OP2_SQL = OP2_SQL.replace("{rules}", ", ".join(map(_rule_sql, RULES)))
