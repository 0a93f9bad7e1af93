"""Scores by edits and words, and their joins, against plain Python over all pairs."""

import random

import pytest

from knigovod.config import Settings
from knigovod.operators import names as nm
from knigovod.operators import registry as rg


def made(n, seed):
    r = random.Random(seed)
    stems = ["alpha", "beta", "trade", "ab", "комерц", "x", "import export", "delta systems", "aaaa", "aaab"]
    out = ["", "a", "ab", "abcdefghijklmnopqrst", "trade", "alpha trade", "trade alpha", "a b c"]
    for _ in range(n):
        name = list(" ".join(r.sample(stems, r.randint(1, 3))) + r.choice(["", " 1", "22"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(name))
            name[at:at + r.randint(0, 1)] = r.choice(["", "q", "z"])
        out.append(" ".join("".join(name).split()))
    return sorted(set(out))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_edits(a, b):
    longer = max(len(a), len(b))
    return round(100.0 * (longer - levenshtein(a, b)) / longer + 1e-9, 1) if a and b else 0.0


def by_words(a, b):
    x, y = set(a.split()), set(b.split())
    common = x & y
    contained = common and len(common) == min(len(x), len(y)) and sum(map(len, common)) >= 4
    return max(round(100.0 * len(common) / max(len(x | y), 1) + 1e-9, 1), 90.0 if contained else 0.0)


@pytest.mark.parametrize("floor", [96.0, 90.0, 72.5, 45.0])
def test_joins_find_all_pairs(spark, floor):
    asked, known = made(60, 1), made(70, 2)
    names = spark.createDataFrame([(f"n{k}", n) for k, n in enumerate(asked)], "name_id string, form string")
    entries = spark.createDataFrame(list(enumerate(known)), "reg_order int, form string")
    scorer = nm.EditsAndWords()
    left, right = scorer.prepared(names, entries)
    found = lambda df: {(r.name_id, r.reg_order): r.score for r in df.collect()}
    wanted = lambda score: {(f"n{i}", j): s for i, a in enumerate(asked) for j, b in enumerate(known) if (s := score(a, b)) >= floor}
    assert found(nm.edit_pairs(left, right, floor)) == wanted(by_edits)
    assert found(nm.word_pairs(left, right, floor)) == wanted(by_words)
    assert found(scorer.pairs(left, right, floor)) == wanted(lambda a, b: max(by_edits(a, b), by_words(a, b)))


def test_a_short_name_inside_a_long_one(spark):
    reg = rg.with_match_form(spark.createDataFrame(
        [(0, "1", "Abc Def"), (1, "2", "Ghi Jkl Group"), (2, "3", "Mno Ltd"), (3, "4", "Kvadrat Komerc")], "reg_order long, id string, name string"))
    names = spark.createDataFrame([("Skopje Abc Def Trgovija Na Golemo",), ("Kvadrat Komrc",), ("ghi",), ("Qqq",), (None,)], "vendor_name string")
    got = {r.vendor_name: (r.komitent_id, r.komitent_score, r.route) for r in rg.match_names(names, reg, Settings(), nm.EditsAndWords()).collect()}
    assert got == {"Skopje Abc Def Trgovija Na Golemo": ("1", 90.0, "similar"), "Kvadrat Komrc": ("4", 90.0, "token")}


def test_winner_equals_a_plain_search(spark):
    asked, known = made(50, 3), made(60, 4)
    reg = spark.createDataFrame([(k, n) for k, n in enumerate(known)], "reg_order long, norm_name string")
    names = spark.createDataFrame([(n, n) for n in asked], "name_id string, form string")
    wanted = {}
    for a in asked:
        scores = sorted(((max(by_edits(a, b), by_words(a, b)), -j) for j, b in enumerate(known)), reverse=True)[:2]
        if scores[0][0] >= 45 and (scores[1][0] < 45 or scores[0][0] >= scores[1][0] + 5):
            wanted[a] = (-scores[0][1], scores[0][0])
    got = {r.name_id: (r.reg_order, r.score) for r in rg.fuzzy_winner(names, reg, Settings(), nm.EditsAndWords()).collect()}
    assert got == wanted
