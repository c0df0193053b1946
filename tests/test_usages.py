"""Terms of a question, and scans with budgets against a walk over the files in order."""

import random

from factloom.operators import usages
from factloom.schema import RELATIONS
from factloom.session import Session


def walk(files, high, broad, limit, budget):
    """Files in order of paths, for high terms and then for broad ones, until lines or files run out."""
    visited, found, seen, why = 0, [], set(), ""
    for phase, terms in enumerate((high, broad)):
        for path, text in sorted(files):
            if len(found) > limit or why or not terms:
                break
            if path.startswith("build/") or not path.endswith(".java"):
                continue
            visited += 1
            if visited > budget:
                why = "file_budget"
                break
            if "\0" in text:
                continue
            for n, line in enumerate(text.split("\n"), 1):
                term = next((t for t in terms if t in line), None)
                if term and (path, n) not in seen and len(found) <= limit:
                    seen.add((path, n))
                    found.append((path, n, term, phase, line.strip()))
    return found[:limit], len(found) > limit, why


def test_scans_by_a_walk(spark):
    rng = random.Random(6)
    line = lambda: "  ".join(rng.choices(["import a.B", "a.B", "B(x)", "other", "über", "a.+"], [1, 1, 2, 6, 2, 1], k=2))
    files = [(f"{rng.choice(['src', 'build', 'lib'])}/F{k}{rng.choice(['.java', '.java', '.md'])}", "\n".join(line() for _ in range(rng.randrange(4))) + rng.choice(["", "", "\0"])) for k in range(40)]
    d = spark.createDataFrame(files, "path string, text string")
    for high, broad, limit, budget in ((["import a.B"], ["a.B", "B("], 5, 100), (["import a.B"], ["a.B", "B("], 100, 100), (["import a.B"], ["a.B"], 100, 15), (["import a.B"], ["a.+"], 100, 30), ([], ["B(", "a.+"], 50, 12), (["none"], [], 9, 9)):
        rows = usages.scan(d, high, broad, limit, budget).orderBy("phase", "path", "line").collect()
        want, more, why = walk(files, high, broad, limit, budget)
        assert [(r["path"], r["line"], r["term"], r["phase"], r["text"]) for r in rows] == want
        assert {(r["has_more"], r["truncated_reason"]) for r in rows} <= {(more, why)}


def test_terms_come_from_the_question_and_what_it_means(spark):
    made = {n: spark.createDataFrame([], RELATIONS[n]) for n in RELATIONS}
    made["classes"] = spark.createDataFrame([("s1", "p.q.Wall", "class", None, 1, False, None)], RELATIONS["classes"])
    made["shards"] = spark.createDataFrame([("s1", "g:stone:1", "stone-1.jar")], "shard_id string, coordinate string, filename string")
    s = Session(made)
    high, broad = usages.question_terms(s, "import p.q.Wall;")
    assert high == ["import p.q.Wall;", "import p.q.Wall", "import static p.q.Wall.", "g:stone:1", "stone-1.jar", "stone"]
    assert broad == ["import p.q.Wall;", "p.q.Wall", "import p.q.Wall", "Wall", "g:stone:1", "stone-1.jar", "stone"]
    assert usages.question_terms(s, "g:stone:1")[0] == ["g:stone:1", "stone", "stone-1.jar"]
    assert usages.question_terms(s, "p.q.*") == (["import p.q.*", "g:stone:1", "stone-1.jar", "stone"], ["p.q.*", "p.q", "import p.q.*", "g:stone:1", "stone-1.jar", "stone"])
    assert usages.question_terms(s, "Wall")[0][2:4] == ["import p.q.Wall", "import static p.q.Wall."]
    assert usages.question_terms(s, "  ") == ([], [])
