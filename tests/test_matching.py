"""Edit-similarity joins, ways of matching and replaced terms, against plain versions over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from quern.operators import matching


def plain_fuzzy(values, wanted, least=0.85, margin=0.05):
    found = {}
    for w in wanted:
        t = (w or "").strip()
        rated = sorted(((SequenceMatcher(None, t.lower(), v.lower()).ratio(), v) for v in {x.strip() for x in values if x and x.strip()} if v != t), reverse=True)
        if rated and len(t) >= 4 and len(rated[0][1]) >= 4 and rated[0][0] >= least and (len(rated) == 1 or rated[0][0] - rated[1][0] >= margin):
            found[w] = rated[0][1]
    return found


def varied(rng, word):
    letters = list(word)
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(letters) + 1)
        how = rng.randrange(3)
        if how == 0:
            letters.insert(at, rng.choice("abcdeé"))
        elif letters and how == 1:
            letters.pop(min(at, len(letters) - 1))
        elif letters:
            letters[min(at, len(letters) - 1)] = rng.choice("abcdeé")
    return "".join(letters)


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_is_complete(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 22))) for _ in range(60)]
    values = words + [varied(rng, w) for w in words for _ in range(2)] + ["Stadt", "stadt", None, "", " x "]
    wanted = [varied(rng, w) for w in words] + ["Stadtt", "abc", "aaaa", None, " Netherlandic "]
    rows = lambda name, items: spark.createDataFrame([(x,) for x in items], f"{name} string")
    found = {r.wanted: r.value for r in matching.fuzzy(rows("value", values), rows("wanted", wanted)).collect()}
    expected = plain_fuzzy(values, wanted)
    assert found == expected and len(expected) > 15


def test_ways(spark):
    values = ["United States of America", "Netherlands", "Berlin", "BERLIN ", "Paris", "Parisian", "Hamburg", "Hamburk", "New York", "Oslo"]
    wanted = ["USA", "netherlands", "Netherland", "Pari", "Hamburc", "new yrok", "Oslo", "oslo", " ", None, "berlin", "Berlinn"]
    rows = lambda name, items: spark.createDataFrame([(x,) for x in items], f"{name} string")
    found = {r.wanted: (r.value, r.how) for r in matching.grounded(rows("value", values), rows("wanted", wanted)).collect()}
    assert found == {
        "USA": ("United States of America", "initials"), "netherlands": ("Netherlands", "case"), "Netherland": ("Netherlands", "prefix"), "Pari": ("Paris", "prefix"),
        "new yrok": ("New York", "fuzzy"), "oslo": ("Oslo", "case"),
    }
    assert matching.grounded(rows("value", values).limit(0), rows("wanted", wanted)).count() == 0


def plain_rewrite(text, terms, limit=0):
    if not text:
        return text, []
    low, taken, groups, found = text.lower(), [], set(), []
    stands = lambda t, a: not (t.isascii() and len(t) < 3 and any(0 <= i < len(low) and (low[i].isascii() and (low[i].isalnum() or low[i] == "_")) for i in (a - 1, a + len(t))))

    def places(t):
        out, at = [], 0
        while (at := low.find(t, at)) >= 0:
            if stands(t, at):
                out.append((at, at + len(t)))
                at += len(t)
            else:
                at += 1
        return out

    for _, _, c in terms:
        taken += places(c.lower())
    for g, t, c in sorted(terms, key=lambda x: (-len(x[1]), x[0], x[1])):
        for a, b in places(t.lower()):
            if not (limit and g not in groups and len(groups) >= limit) and not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                groups.add(g)
                found.append((a, b, t, c))
    out, at, told = "", 0, []
    for a, b, t, c in sorted(found):
        out += text[at:a] + c
        at = b
        if (t, c) not in told:
            told.append((t, c))
    return out + text[at:], told


@pytest.mark.parametrize("part,limit", [(50_000, 0), (5, 0), (5, 2)])
def test_rewritten(spark, part, limit):
    rng = random.Random(4)
    terms = [(f"g{i % 7}", "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))).strip() or "ab", f"<{i % 7}>") for i in range(14)] + [("h", "華東", "華東集團"), ("k", "ab a", "ABAB")]
    texts = ["".join(rng.choice("ab é,B") for _ in range(rng.randrange(0, 40))) for _ in range(150)] + ["華東 和 華東集團", None, "", "İab ab"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, matched string")
    known = spark.createDataFrame([*terms, ("x", " ", "y"), ("x", "y", None), ("x", "same", "SAME"), *terms[:3]], "group string, term string, canonical string")
    found = {r.doc_id: (r.rewritten, [tuple(m) for m in r.matched]) for r in matching.rewritten(docs, known, limit=limit, part=part).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        if t != "İab ab":
            assert found[i] == plain_rewrite(t, sorted(set(terms)), limit)
    assert matching.rewritten(docs.limit(0), known).count() == 0 and matching.rewritten(docs, known.limit(0)).where("rewritten <> text or size(matched) > 0").count() == 0
