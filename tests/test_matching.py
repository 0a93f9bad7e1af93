"""Registry, accounts and substring joins against plain Python on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knigovod.config import Settings
from knigovod.operators import accounts as ac
from knigovod.operators import contains as ct
from knigovod.operators import registry as rg


def registry(spark, names):
    df = spark.createDataFrame([(i, str(100 + i), n) for i, n in enumerate(names)], "reg_order long, id string, name string")
    return rg.with_match_form(df)


def pairs(df):
    return {(r.text_id, r.needle_id) for r in df.collect()}


def test_contains_join_ways_agree(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(i, word(30)) for i in range(60)] + [(99, "")]
    needles = [(i, word(rng.choice([1, 2, 3, 4, 5]))) for i in range(40)]
    t = spark.createDataFrame(texts, "text_id int, text string")
    n = spark.createDataFrame(needles, "needle_id int, needle string")
    wanted = {(i, j) for i, text in texts for j, needle in needles if needle in text}
    assert pairs(ct.contains_join(t, n)) == wanted
    assert pairs(ct.contains_join(t, n, limit=5)) == wanted
    assert pairs(ct.contains_by_automaton(t, n, letters=10)) == wanted
    more = spark.createDataFrame([(None, "abc"), (7, None)], "text_id int, text string")
    again = n.unionByName(spark.createDataFrame([(100, needles[0][1]), (101, "")], "needle_id int, needle string"))
    got = pairs(ct.contains_by_automaton(t.unionByName(more), again))
    assert {x for x in got if x[0] is not None and x[1] < 100} == wanted and {i for i, j in got if j == 100 and i is not None} == {i for i, j in wanted if j == 0}
    assert pairs(ct.contains_by_automaton(t.limit(0), n)) == pairs(ct.contains_by_automaton(t, n.limit(0))) == set()
    assert pairs(ct.contains_join(t, n.filter("needle_id < 0"))) == set()


def dice(a, b):
    grams = lambda s: {s[i:i + 3] for i in range(len(s) - 2)}
    x, y = grams(a), grams(b)
    return round(200.0 * len(x & y) / (len(x) + len(y)) + 1e-9, 1)


@pytest.mark.parametrize("spread_out", [False, True])
def test_similar_names_are_all_found(spark, monkeypatch, spread_out):
    if spread_out:
        monkeypatch.setattr(rg, "SALT_EVERY", 3)
        monkeypatch.setattr(rg, "MAX_BROADCAST_BYTES", 0)
    rng = random.Random(5)
    stems = ["Alpha Trade", "Beta Group", "Gama Trade Import", "Delta Systems"]
    names = [f"{rng.choice(stems)} {rng.choice('xyz')}{rng.randrange(30)}" for _ in range(60)]
    asked = list({n.replace("a", "e", 1) for n in names[:30]})
    reg = registry(spark, names)
    form = lambda s: " " + " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()) + " "
    norm = {r.reg_order: form(r.norm_name) for r in reg.collect()}
    wanted = {}
    for a in asked:
        scores = sorted(((dice(form(a), f), -i) for i, f in norm.items()), reverse=True)[:2]
        if scores[0][0] >= 45 and (scores[1][0] < 45 or scores[0][0] >= scores[1][0] + 5):
            wanted[a] = (-scores[0][1], scores[0][0])
    names_df = spark.createDataFrame([(a, form(a)) for a in asked], "name_id string, form string")
    got = {r.name_id: (r.reg_order, r.score) for r in rg.fuzzy_winner(names_df, reg).collect()}
    assert got == wanted


def match(spark, reg, *names, settings=Settings()):
    df = spark.createDataFrame([(n,) for n in names], "vendor_name string")
    return {r.vendor_name: (r.komitent_id, r.route) for r in rg.match_names(df, reg, settings).collect()}


def test_name_routes(spark):
    reg = registry(spark, ["Пример Трговија ДООЕЛ", "Втора Трговија АД", "Трета Фирма", "Сончоглед Импорт", "Trade One", "Kasa Sys"])
    got = match(spark, reg, "PRIMER d.o.o.", "Трговија втора", "Soncoglet", "Nepoznato", "Ka5a")
    assert got["PRIMER d.o.o."] == ("100", "token")
    assert got["Трговија втора"] == ("101", "candidates")
    assert "Nepoznato" not in got
    aliased = Settings(vendor_aliases=((r"\bka.a\b", "Kasa", "kasa"),))
    assert match(spark, reg, "KA5A", settings=aliased)["KA5A"] == ("105", "alias")


def test_scan_and_cascade(spark):
    reg = registry(spark, ["Akvarel Studio", "Akvarel Dom Dom", "Купувач Пример"])
    assert {r.token for r in rg.fingerprints(reg).collect()} == {"studio", "kupuvach", "primer"}
    docs = spark.createDataFrame(
        [("a", "Непознат", "нешто од АкварелСТУДИО"), ("b", "Непознат", "Купувач"), ("c", "Akvarel Studio", "x")],
        "doc_id string, vendor_name string, full_text string")
    got = {r.doc_id: (r.vendor_name, r.komitent_id) for r in rg.resolve(docs, reg, Settings(buyer_pattern="Купувач")).collect()}
    assert got == {"a": ("Akvarel Studio", "100"), "b": ("Непознат", None), "c": ("Akvarel Studio", "100")}


def vectors(rng, n, dim=8, around=None):
    v = rng.normal(size=(n, dim)) if around is None else around[rng.integers(len(around), size=n)] + 0.1 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_nearest_ways_agree(spark):
    rng = np.random.default_rng(1)
    centres = vectors(rng, 5)
    items, asked = vectors(rng, 300, around=centres), vectors(rng, 200, around=centres)
    df = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>")
    q, i = df(asked, "query_id"), df(items, "item_id")
    sims = asked.astype(np.float32).astype(float) @ items.astype(np.float32).astype(float).T
    wanted = {k: int(s.argmax()) for k, s in enumerate(sims) if s.max() >= 0.9}
    whole = {r.query_id: r.item_id for r in ac.nearest(q, i, 0.9).collect()}
    parts = {r.query_id: r.item_id for r in ac._nearest_by_pivots(q, i, 0.9, False, 8, 8 * 8 * 7, block_rows=16).collect()}
    assert whole == wanted and parts == wanted
    assert {r.query_id: r.item_id for r in ac.nearest(q, i, 0.9, max_bytes=8 * 8 * 7).collect()} == wanted


def approvals(spark, *rows):
    return spark.createDataFrame(
        [(i, [float(x) for x in v], k, None, "") for i, v, k in rows],
        "corr_id long, embedding array<float>, konto string, komitent_id string, preview string")


def test_learning_twice_adds_nothing(spark):
    known = approvals(spark, (1, [1, 0], "4111"), (2, [0, 1], "4030"))
    once = ac.learn(known, approvals(spark, (10, [1, 0.01], "4112"), (11, [0.7, 0.7], "4140")))
    assert {(r.corr_id, r.konto) for r in once.collect()} == {(1, "4112"), (2, "4030"), (11, "4140")}
    again = ac.learn(known, approvals(spark, (10, [0.6, 0.8], "1"), (11, [0.6, 0.8], "2"), (12, [0.6, 0.8], "")))
    assert {(r.corr_id, r.konto) for r in again.collect()} == {(1, "4111"), (2, "4030"), (10, "2")}


def test_suggestion_cascade(spark):
    corrections = approvals(spark, (1, [1, 0, 0], "4112"))
    chart = spark.createDataFrame([(0, "4030", [0.0, 1.0, 0.0]), (1, "2200", [0.0, 0.0, 1.0])], "acct_order long, code string, embedding array<float>")
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0], "x"), (2, [0.0, 1.0, 0.0], "x"), (3, [0.0, 0.0, 1.0], "ИНТЕРНЕТ услуга"), (4, [0.0, 0.0, 1.0], "ништо")],
        "query_id long, embedding array<float>, text string")
    got = {r.query_id: (r.konto, r.method, r.confidence) for r in ac.suggest(asked, corrections, chart, ac.konto_rules(spark)).collect()}
    assert got == {1: ("4112", "learned_correction", 1.0), 2: ("4030", "embedding_match", 1.0), 3: ("4112", "keyword", 0.0),
                   4: ("4499", "keyword", 0.0)}


def test_many_rules_go_by_join(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Нафта и струја"), (2, "нафта"), (3, "x")], "text_id long, text string")
    rules = ac.konto_rules(spark)
    inline = {r.text_id: r.rule_konto for r in ac.suggest_by_rules(texts, rules).collect()}
    monkeypatch.setattr(ac, "listed_rules", lambda _: None)
    monkeypatch.setattr(ac, "contains_join", lambda t, n: ct.contains_join(t, n, limit=1))
    joined = {r.text_id: r.rule_konto for r in ac.suggest_by_rules(texts, rules).collect()}
    assert inline == joined == {1: "4030", 2: "4032", 3: None}


def test_expense_accounts(spark):
    chart = spark.createDataFrame([(0, "4030", "a"), (1, "2200", "b")], "acct_order long, code string, description string")
    assert [r.code for r in ac.expense_accounts(chart).collect()] == ["4030"]
    assert [r.code for r in ac.expense_accounts(chart.filter("code = '2200'")).collect()] == ["2200"]
    twice = spark.createDataFrame([(0, "1", "a"), (1, " 1 ", "b"), (2, "", "c")], chart.schema)
    assert [(r.acct_order, r.code, r.description) for r in ac.clean_accounts(twice).collect()] == [(0, "1", "b")]


def one_by_one(known, new, at_least):
    """The corrections after the approvals, learned in order: (corr_id, konto) of each place."""
    held = [[i, np.array(v, np.float32).astype(float), k] for i, v, k in known]
    for i, v, k in new:
        if not k:
            continue
        v = np.array(v, np.float32).astype(float)
        sims = [h[1] @ v for h in held]
        if sims and max(sims) >= at_least:
            held[int(np.argmax(sims))][1:] = [v, k]
        else:
            held.append([i, v, k])
    return {(h[0], h[2]) for h in held}


@pytest.mark.parametrize("max_bytes", [None, 8 * 8 * 7])
def test_learning_in_order_of_arrival(spark, monkeypatch, max_bytes):
    """Chains, groups of near copies, equal vectors; small table and partitions around pivots."""
    if max_bytes:
        searched = ac._searched
        monkeypatch.setattr(ac, "_searched", lambda q, i, t, e, l, _: searched(q, i, t, e, l, max_bytes))
    rng = np.random.default_rng(4)
    wide, chain = vectors(rng, 60), vectors(rng, 1)[0]
    other = vectors(rng, 1)[0]
    other -= (other @ chain) * chain
    other /= np.linalg.norm(other)
    drift = [np.cos(a) * chain + np.sin(a) * other for a in np.arange(0, 3, 0.2)]
    rows = [*wide[:20], *vectors(rng, 60, around=wide[:6]), *drift, *drift[::3], *wide[:10], *[wide[0]] * 15]
    rng.shuffle(rows)
    known = [(i, list(v), f"k{i}") for i, v in enumerate([*wide[:4], *wide[40:], drift[5]])]
    new = [(1000 + i, list(v), "" if i % 17 == 5 else f"n{i}") for i, v in enumerate(rows)]
    settings = ac.Settings(duplicate_similarity=0.95)
    out = ac.learn(approvals(spark, *known), approvals(spark, *new), settings)
    assert {(r.corr_id, r.konto) for r in out.collect()} == one_by_one(known, new, 0.95)
