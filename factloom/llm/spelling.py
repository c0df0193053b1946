"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of
times. One inserted or deleted letter flips one bit, a replaced one at most two. The
bits are dealt into three bands, so at least one band of two near words is equal: words are joined
on an equal band, with lengths that differ by one at most, and verified.

A band alone is shared by a fixed part of all words, so the join would grow with the square of the vocabulary.
Its key therefore holds, besides band and length, half a word: of two words one edit apart, the shorter of L
letters, either the first L/2 letters or the last L - L/2 agree. A pair that shares several keys is
taken at the first of them, so no pair comes twice and nothing has to be made distinct.

The root of a word is at the end of its chain of forms; a form is at least ten times as frequent, so
chains are short and end. They are followed by joining the chain table with itself, which doubles the steps in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, table

RUN_PATTERN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 7, 2, 10
BANDS = 3
#: Bits of the mask: the letters a to z, then U+00C0 to U+00FF; any other character shares one of these bits, which can only flip fewer.
BITS = 26 + 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, typo_every: int = 31) -> DataFrame:
    """(word) for each run of letters of whole texts that has ``min_length`` code points at least. A-Z are lower-cased; where ``typo_every`` divides the
    CRC-32 of id, colon and run, that number modulo the length says which code point is deleted (before the length is looked at). Null texts have no runs; a null id is written as nothing."""
    # a greedy match of at least so many letters is a whole run: shorter runs match nowhere
    pattern = RUN_PATTERN.removesuffix("+") + "{" + str(min_length) + ",}"
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("run"))

    def typed(h: Column) -> Column:
        at = (h % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        return F.when(h % typo_every == 0, cut).otherwise(F.col("run"))

    words = found.select(let(F.crc32(F.concat("id", F.lit(":"), "run")), typed).alias("word"))
    return words.where(F.char_length("word") >= min_length)


def bit_of(letter: Column) -> Column:
    """The bit of a letter, from 0."""
    code = F.ascii(letter)
    return F.pmod(F.when(code < 192, code - 97).otherwise(code - 166), F.lit(BITS))


def masks(word: Column) -> Column:
    """An array of the word's bands; neighbouring bits are in different bands, so that each has frequent letters."""
    bits = F.transform(F.split(word, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(bit_of(c)))

    def band(k: int, of: Column) -> Column:
        mine = F.filter(of, lambda b: (b >= 0) & (b % BANDS == k))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b / BANDS).cast("int"))))

    return let(bits, lambda of: F.array(*[band(k, of) for k in range(BANDS)]))


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) once for any two of the distinct, non-null ``word``s that differ by exactly one inserted, deleted or replaced code point; a is the shorter, or of equal length and before b in code-point order."""
    w = scratch.write(words.select("word", F.char_length("word").alias("len"), masks(F.col("word")).alias("m")), "masks")

    def keyed(lengths: Column, name: str) -> DataFrame:
        at = w.select("word", "len", "m", F.explode(lengths).alias("l"))
        first, last = F.substring("word", F.lit(1), (F.col("l") / 2).cast("int")), F.expr("right(word, l - int(l / 2))")
        spots = F.array(*[F.struct(F.lit(k).alias("band"), F.get("m", F.lit(k)).alias("bits"), F.lit(side).alias("side"), half.alias("half")) for k in range(BANDS) for side, half in enumerate((first, last))])
        return at.select(F.struct("word", "len", "m").alias(name), "l", first.alias(f"{name}_first"), F.explode(spots).alias("s")).select(name, f"{name}_first", "l", "s.*")

    short, other = keyed(F.array("len"), "a"), keyed(F.array("len", F.col("len") - 1), "b")
    equal = [F.get("a.m", F.lit(k)) == F.get("b.m", F.lit(k)) for k in range(BANDS)]
    flipped = sum((F.bit_count(F.get("a.m", F.lit(k)).bitwiseXOR(F.get("b.m", F.lit(k)))) for k in range(1, BANDS)), F.bit_count(F.get("a.m", F.lit(0)).bitwiseXOR(F.get("b.m", F.lit(0)))))
    seen = F.lit(False)
    for k in range(BANDS - 1):  # an earlier band is equal, too
        seen = seen | ((F.col("band") > k) & equal[k])
    seen = seen | ((F.col("side") == 1) & (F.col("a_first") == F.col("b_first")))
    ordered = (F.col("b.len") > F.col("a.len")) | (F.col("a.word") < F.col("b.word"))
    keys = ["band", "bits", "side", "l", "half"]
    met = short.join(other, keys).where(ordered & (flipped <= 2) & ~seen & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))


def variants(counts: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (word, n), whose words are distinct and not null.

    A word's form is its near word of largest n, ties to the first in code-point order, if it is ``min_ratio`` (above 1) times as frequent or more; else
    null. The root is the last word of the chain of forms, or the word itself. A word without near words has n_near 0. An empty table gives none.
    """
    scratch = Scratch(counts.sparkSession, "spelling")
    c = scratch.write(counts.select("word", "n"), "counts")
    pairs = scratch.write(near_pairs(c, scratch), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    best = both.join(c.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    found = scratch.write(
        c.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("top.minus") >= min_ratio * F.col("n"), F.col("top")).alias("top")),
        "forms",
    )
    # every word of a chain but the last points on; a round lets each point where its target points
    chain = scratch.write(found.where(F.col("top").isNotNull()).select("word", F.col("top.near").alias("root")), "chain")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.write(chain.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        more = not step.where("moved").isEmpty()
        scratch.drop(chain)
        chain = step
        if not more:
            break
    return found.join(chain.select("word", "root"), "word", "left").select("word", F.col("top.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("top.minus")).alias("form_n"))


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(word, n) of the words that ``runs`` finds ``min_count`` times at least."""
    return runs(docs, **how).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))


#: Near words in another way: two words are one edit apart if they agree after one deletion at the same place in both, or one in the longer alone. (DuckDB's levenshtein
#: counts bytes.) The CRC-32 is taken byte by byte from its table, which is derived from the polynomial.
OP13_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), g AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), x AS (
  SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS bytes FROM g
), h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) AS h FROM x, t
), y AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h
), w AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM y WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
), d AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS part FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), l AS MATERIALIZED (
  SELECT DISTINCT d.word, w.word AS near FROM d JOIN w ON w.word = d.part
), p AS MATERIALIZED (
  SELECT word, near FROM l UNION ALL SELECT near, word FROM l UNION ALL SELECT DISTINCT a.word, b.word FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
), f AS MATERIALIZED (
  SELECT w.word, w.n, count(p.near) AS n_near, min({{'minus': -v.n, 'near': p.near}}) AS top FROM w LEFT JOIN p ON p.word = w.word LEFT JOIN w v ON v.word = p.near GROUP BY w.word, w.n
), o AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN -top.minus >= {MIN_RATIO} * n THEN top.near END AS form, CASE WHEN -top.minus >= {MIN_RATIO} * n THEN -top.minus END AS form_n FROM f
), c(word, last, form) AS (
  SELECT word, word, form FROM o UNION ALL SELECT c.word, o.word, o.form FROM c JOIN o ON o.word = c.form
)
SELECT o.word, o.form, c.last AS root, o.n, o.n_near, o.form_n::BIGINT AS form_n FROM o JOIN c ON c.word = o.word AND c.form IS NULL
"""
