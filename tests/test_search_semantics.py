"""Search on generated values against the same rules in SQLite, whose LIKE and ordering they follow."""

import random
import sqlite3
import string

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import package_name, simple_name
from factloom.operators import search
from factloom.schema import RELATIONS
from factloom.session import Session

#: Letters of both cases, the marks that patterns give a meaning, NUL, line ends, letters beyond ASCII with and without a lower-case form.
ALPHABET = string.ascii_letters[:4] + string.ascii_uppercase[:4] + "%_\\#$\0\n\u00c5\u00e5\u0130\u03a9\u6f22\U0001f680"


def strings_of(rng, n, most):
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(most))) for _ in range(n)]


def names_of(rng, n):
    """Names of parts that may be empty, joined by any number of dots."""
    return [".".join(strings_of(rng, rng.randrange(1, 5), 4)) for _ in range(n)]


def pieces_of(rng, values, n):
    """Terms: whole values, pieces of them and the same in the other case, without NUL, which no term may hold."""
    out = []
    while len(out) < n:
        v = rng.choice(values)
        at = rng.randrange(len(v) + 1)
        piece = rng.choice([v, v[at : at + rng.randrange(1, 4)], v.rpartition(".")[2], v[:at]])
        piece = rng.choice([piece, piece.swapcase()])
        if piece and "\0" not in piece:
            out.append(piece)
    return out


@pytest.fixture(scope="module", params=[11, 12, 13])
def session(spark, request):
    rng = random.Random(request.param)
    names = names_of(rng, 80)
    owners = sorted({(f"s{rng.randrange(3)}", f) for f in names for _ in range(rng.randrange(1, 3))})
    rows = [(*o, rng.choice(["class", "interface"]), None, 1, False, None) for o in owners]
    values = strings_of(rng, 60, 12) + ["".join(rng.choices(ALPHABET, k=9000))]
    strings = [(*rng.choice([*owners, ("s9", "owned by no class")]), None, None, v) for v in values]
    made = {n: spark.createDataFrame([], RELATIONS[n]) for n in RELATIONS}
    made["classes"] = spark.createDataFrame(rows, RELATIONS["classes"])
    made["strings"] = spark.createDataFrame(strings, RELATIONS["strings"])
    return Session(made), rows, strings, rng


def like(term):
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def test_find_class_follows_sqlite(session):
    s, rows, _, rng = session
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE c (shard TEXT, fqn TEXT, simple TEXT)")
    db.executemany("INSERT INTO c VALUES (?, ?, ?)", [(r[0], r[1], r[1].rsplit(".", 1)[-1]) for r in rows])
    for term in pieces_of(rng, [r[1] for r in rows], 12):
        prefix = term if term.isascii() else None  # only terms of ASCII find prefixes
        want = db.execute(
            "SELECT * FROM (SELECT shard, fqn, CASE WHEN fqn = ?1 THEN 100 WHEN simple = ?1 THEN 90 WHEN substr(simple, 1, ?4) = ?3 THEN 82 WHEN substr(fqn, 1, ?4) = ?3 THEN 80"
            " WHEN fqn LIKE ?2 ESCAPE '\\' THEN 50 END AS score FROM c) WHERE score NOT NULL ORDER BY score DESC, fqn, shard LIMIT 20",
            (term, like(term), prefix, len(term)),
        ).fetchall()
        got = [(r.shard_id, r.fqn, r.score) for r in search.find_class(s, term).collect()]
        assert sorted(got) == sorted(want), term


def test_find_string_follows_sqlite(session):
    s, rows, strings, rng = session
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (shard TEXT, v TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(r[0], r[4]) for r in strings if (r[0], r[1]) in {(x[0], x[1]) for x in rows}])
    for text in pieces_of(rng, [r[4] for r in strings if r[4]], 12):
        want = db.execute("SELECT shard, v FROM t WHERE v LIKE ? ESCAPE '\\'", (like(text),)).fetchall()
        assert sorted((r.shard_id, r.value) for r in search.find_string(s, text).collect()) == sorted(want), text


def test_names_are_split_at_the_last_dot(spark):
    names = names_of(random.Random(5), 300)
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", package_name(F.col("n")), simple_name(F.col("n"))).collect()
    for n, p, s in rows:
        assert (p, s) == ((n.rpartition(".")[0], n.rpartition(".")[2]) if "." in n else ("", n))


def test_pages_are_bounded(session):
    s = session[0]
    for page, size in ((0, 20), (1, 0), (1, 1001), (5001, 20)):
        with pytest.raises(ValueError):
            search.find_class(s, "w", page, size)


@pytest.mark.parametrize(
    ("text", "kind"),
    [("import a.b.C;", "import"), ("import static a.B.c;", "static_import"), ("import a.b.*;", "package_import"), ("a.B#c", "method"), ("g:a:1", "artifact"), ("x.jar", "artifact"), ("a.B", "class"), ("  ", "unknown")],
)
def test_questions_are_classified(text, kind):
    from factloom.functions.text import classify

    assert classify(text)[0] == kind


def test_text_is_cut_between_characters(spark):
    from factloom.functions.text import utf8_cut

    rows = spark.createDataFrame([("é" * 200,), ("abc",), ("x" * 239 + "é",)], "t string").select(utf8_cut(F.col("t"), 240).alias("t")).collect()
    assert [r.t for r in rows] == ["é" * 120, "abc", "x" * 239]
