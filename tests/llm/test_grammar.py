"""The clause grammar of the toxicity operator: examples, a version that looks at each word's surroundings, and the trained model."""

import random
import re

import numpy as np
import pytest

from factloom.llm import toxicity

STEMS = {"idio": 4.0, "idiot ": 5.0, "moro": 2.5}


def kinds(text):
    return [k for k, _ in toxicity.clauses(text, toxicity.lexical(STEMS))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("an Idiot. x", ["plain"]), ("you idiotic", ["aimed"]), ("idiots like you", ["aimed"]), ("idiots, you are", ["plain"]), ("you, idiot", ["aimed"]), ("they are idiots", ["aimed"]),
        ("not an idiot", ["negated"]), ("not only are you an idiot", ["aimed"]), ("you idiot never do that", ["aimed"]), ("not clever but an idiot", ["plain"]), ("no, you idiot", ["aimed"]),
        ("I don't think you are an idiot", ["negated"]), ("not one of the many people here is an idiot", ["plain"]),
        ("she said: x", []), ("she said the idiot", ["reported"]), ("she wrote: you idiot", ["reported"]), ("you idiot, he said", ["reported"]), ("an idiot, you said", ["plain"]), ("She said. You idiot", ["aimed"]),
        ("I will kill you", ["threat"]), ("kill yourself", ["threat"]), ("I will never hurt you", ["negated"]), ("he told me: I will kill you", ["reported"]), ("smoking can kill you", ["harm"]), ("I heard they kill you", ["harm"]),
        ("ich werde dich töten", ["threat"]), ("je vais te tuer", ["threat"]), ("voy a matarte", ["threat"]), ("they beat the record", []), ("You can kill the process", []), ("you, I kill", []), ("kill, you", []),
        ("the storm will hit them and destroy the harvest", []), ("I'll shoot you an email", []), ("I kill your darlings", []), ("xidiot", []), ("... !", []), ("", []), (None, []),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == want


def brute(text, stems):
    """Each insult's and verb's pattern from the words around it, without states."""
    out = []
    for hard in re.split(r"[.!?;\n]", text.lower()):
        before = False
        for clause in hard.split(":"):
            words, commas = [], []  # the number of commas before each word
            n = 0
            for token in re.findall(r"[^\W\d_]+|[,()]", clause):
                if token in ",()":
                    n += 1
                else:
                    words.append(token)
                    commas.append(n)
            cls = [toxicity.CLASSES.get(w, ("word",))[0] for w in words]
            hit = [max([v for s, v in stems.items() if w == s.strip() or s[-1] != " " and w.startswith(s)], default=0.0) for w in words]
            cut = lambda i, j: commas[i] != commas[j] or "contrast" in cls[i + 1 : j]
            sums, quoted = {}, False
            for i, c in enumerate(cls):
                if c == "report":
                    start = next(k for k in range(len(words)) if commas[k] == commas[i])
                    quoted |= commas[i] > 0 and i - start < toxicity.BEHIND and "target" not in cls[start:i]
                    continue
                if not hit[i] and c not in toxicity.VERBS:
                    continue
                j = max((k for k in range(i) if cls[k] == "negation"), default=None)
                negated = j is not None and i - j <= toxicity.SCOPE and not cut(j, i) and cls[j + 1] != "only"
                near = max((k for k in range(i) if cls[k] in ("target", "subject")), default=None)
                if before or "report" in cls[:i]:
                    kind = "reported"
                elif negated:
                    kind = "negated"
                else:
                    kind = None
                ahead = [k for k in range(i + 1, min(i + toxicity.VICTIM, len(words) - 1) + 1) if not cut(i, k)]
                if hit[i]:
                    later = [k for k in ahead if cls[k] in ("target", "subject") and not any(hit[i + 1 : k])]
                    kind = kind or ("aimed" if later or near is not None and i - near <= toxicity.REACH else "plain")
                    sums[kind] = sums.get(kind, 0.0) + hit[i]
                    continue
                agent = max((k for k in range(i) if cls[k] == "agent"), default=-1)
                meant = i == 0 or agent >= 0 and "subject" not in cls[agent:i]
                later = [k for k in ahead if cls[k] == "target" and not set(cls[i + 1 : k]) & set(toxicity.VERBS)]
                if later or c == "infinitive" and near is not None and cls[near] == "target" and i - near <= toxicity.VICTIM + 1:
                    kind = kind or ("threat" if meant else "harm")
                    sums[kind] = sums.get(kind, 0.0) + toxicity.VERB_WEIGHT
            before |= "report" in cls
            if sums:
                out.append({"reported": sum(sums.values())} if quoted else sums)
    return [{k: round(v, 6) for k, v in x.items()} for x in out]


def test_clauses_by_brute_force(monkeypatch):
    a = toxicity.lexical(STEMS)
    rng = random.Random(3)
    vocabulary = "idiot idiots moron xmoron kill hurt matar you them they i not never only but said told the of house a1b ünï".split()
    between = [" "] * 12 + [", ", "-", ". ", "!", ";", "\n", " 3 ", ": ", " (", " , , "]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(between) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocabulary) + rng.choice(between) + "or " * rng.choice([0, 0, 1, 2, 4, 5, 9]) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    for piece in (toxicity.PIECE, 7, 1):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for t in texts:
            found = [(k, round(w, 6)) for k, w in toxicity.clauses(t, a)]
            assert sorted(found) == sorted(x for c in brute(t, STEMS) for x in c.items()), t


def test_no_end_of_states():
    """States of the product are few, whatever is read: windows bound them."""
    assert len(toxicity.GRAMMAR.states) < 50_000


def test_long_text_is_read_whole():
    a = toxicity.lexical(STEMS)
    assert [k for k, _ in toxicity.clauses("a house " * 400_000 + "you idiot. " + "a house. " * 200_000 + "an idiot", a)] == ["aimed", "plain"]


def test_priors_of_unseen_patterns_grow_with_the_constant():
    assert toxicity.Model(STEMS, toxicity.PRIOR.copy()).score("I will kill you") > 0.5 > toxicity.Model(STEMS, toxicity.PRIOR.copy()).score("smoking can kill you")
    x = np.zeros((400, toxicity.N_FEATURES))
    x[:200, :2] = 6.0, 3.0
    w = toxicity.fit(x, np.repeat([1.0, 0.0], 200))
    assert w[0] < toxicity.BIAS and toxicity.Model(STEMS, w).score("I will kill you") > 0.7


def test_trained_model_reads_order(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    assert model.stems
    toxic, clean = ["I will kill you", "kill yourself", "ich werde dich töten", "voy a matarte"], ["they beat the record", "you can kill the process", "smoking can kill you", "he told me: I will kill you", "I will never hurt you", "the storm will hit them and destroy the harvest", "", None]
    assert min(map(model.score, toxic)) >= 0.5 > max(map(model.score, clean))
    stem = max(model.stems, key=lambda s: (model.stems[s], s)).strip()
    said, told = f"You {stem}. Oh you {stem}. You are a {stem}.", f"He said you {stem}. He called you a {stem}. You are not a {stem}."
    bare = lambda t: sum(w.startswith(stem) for w in re.findall(r"\w+", t))
    assert bare(said) == bare(told) and model.score(said) >= 0.5 > model.score(told)
