"""Dependency trees read as a data source."""

import random

import pytest

from factloom.sources import tgf


def read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.tgf").write_text(text)
    return tgf.trees(tgf.read(spark, str(tmp_path)))


def test_files_are_trees_of_their_own(spark, tmp_path):
    a = "1 g:root:jar:1\n2 g:a:jar:1:compile\n\n3 g:b:jar:x:2:test\n#\n1 2 compile\n2 3 test\n1 3 test\n9 2\n"
    b = "1 g:a:pom:7\n2 g:lone:jar:3:compile\n3 g:under:jar:4\n#\n8 3 compile\n"
    found = {(r["file"][-5], r["coordinate"]): r.asDict() for r in read(spark, tmp_path, a=a, b=b).collect()}
    told = {k: (r["parent"], r["depth"], r["direct"], r["trail"], r["scope"]) for k, r in found.items()}
    assert told == {
        ("a", "g:root:1"): ("", 0, False, [], None),
        ("a", "g:a:1"): ("g:root:1", 1, True, ["g:a:1"], "compile"),
        ("a", "g:b:2"): ("g:a:1", 2, False, ["g:a:1", "g:b:2"], "test"),
        ("b", "g:a:7"): ("", 0, False, [], None),
        ("b", "g:lone:3"): ("", 0, False, [], "compile"),
        ("b", "g:under:4"): ("", 1, False, ["g:under:4"], None),  # its parent is in no line
    }


@pytest.mark.parametrize(
    ("text", "told"),
    [("junk\n#\n", "line 1: malformed node 'junk'"), ("1 g:a:jar:1\n#\nlonely\n", "line 3: malformed edge 'lonely'"), ("\n1 not-so\n", "line 2: 'not-so' isn't a coordinate"), ("1 g::jar:1\n", "line 1: 'g::jar:1' isn't"), ("", "the tree is empty")],
)
def test_errors_name_file_and_line(spark, tmp_path, text, told):
    with pytest.raises(Exception, match="bad.tgf: " + told):
        read(spark, tmp_path, bad=text).collect()


def test_a_cycle_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="cycle: 2, 3"):
        read(spark, tmp_path, c="1 g:r:jar:1\n2 g:a:jar:1\n3 g:b:jar:1\n#\n2 3\n3 2\n")


def test_deep_trees_by_a_walk(spark, tmp_path):
    rng, n = random.Random(2), 120
    up = {k: k - 1 if k < 60 else rng.randrange(k) for k in range(1, n)}
    text = "".join(f"{k} g:a{k}:jar:1:compile\n" for k in range(n)) + "#\n" + "".join(f"{p} {k}\n" for k, p in up.items())
    for r in read(spark, tmp_path, deep=text).collect():
        k, trail = int(r["artifact"][1:]), []
        while k in up:
            trail, k = [f"g:a{k}:1", *trail], up[k]
        assert r["trail"] == trail and r["depth"] == len(trail) and r["direct"] == (len(trail) == 1)
