import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import leaks, packing, text, topics

# --- normalisation ---------------------------------------------------------------------------------------------------


def test_normalise():
    assert text.words("The <b>GRЕY</b>-striped la­mp​ at ３.５ s, 1,304 frames") == ["the", "grey", "striped", "lamp", "at", "35", "s", "1304", "frames"]
    assert text.words("编码12紧跟733，此时") == list("编码") + ["12"] + list("紧跟") + ["733"] + list("此时")
    assert text.words("Gummidichtung fÃ¼r Prüfmatte") == ["gummidichtung", "für", "prüfmatte"]
    assert text.words("") == [] and text.words("​ \n") == []
    assert len(text.words("x " * 200_000)) == 200_000


# --- packing ----------------------------------------------------------------------------------------------------------

DOC = "doc_id long, text string, source string, lang string, n_tokens long, grp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2) for i, t, s in rows], DOC)


def check_packing(rows, counts, containers):
    cap = dict(containers)
    for kind in cap:
        mine = [r for r in rows if r["container_kind"] == kind]
        seen, load, n_docs = {}, {}, {}
        for r in mine:
            seen.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"]))
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            n_docs[r["container_id"]] = n_docs.get(r["container_id"], 0) + 1
        assert set(seen) == {d for d, n in counts.items() if n > 0}
        for d, parts in seen.items():
            parts.sort()
            assert parts[0][0] == 0 and sum(n for _, n in parts) == counts[d]
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert len(parts) == 1 or counts[d] > cap[kind]  # whole unless longer than a container
            assert all(n == cap[kind] for _, n in parts[:-1])
        assert max(load.values(), default=0) <= cap[kind] and max(n_docs.values(), default=0) <= max(16, cap[kind] // 16)
    return load


def test_pack(spark):
    rng = random.Random(1)
    counts = {i: rng.choice([1, 5, 40, 100, 129, 700]) for i in range(600)} | {1000: 0}
    df = spark.createDataFrame([(d, n) for d, n in counts.items() if n], "doc_id long, n_tokens long")
    kinds = [("a", 128), ("b", 512), ("none", None), ("zero", 0)]
    rows = packing.pack(df, kinds, group_items=100).collect()
    check_packing(rows, counts, [("a", 128), ("b", 512)])
    total = sum(counts.values())
    used = len({r["container_id"] for r in rows if r["container_kind"] == "b"})
    assert used <= 1.04 * total / 512 + 1
    rep = {r["container_kind"]: r for r in packing.fill_report(packing.pack(df, kinds), kinds).collect()}
    assert rep["b"]["n_tokens"] == total and rep["b"]["fill"] > 0.95


def test_groups_stay_small(spark, monkeypatch):
    """Items of 52 to 90 % of the capacity go into a container each, and no task holds more than about a group of them."""
    rng = random.Random(7)
    counts = {i: rng.randrange(520, 901) for i in range(4000)}
    seen = spark.sparkContext.accumulator(0)  # rows of groups above twice the size asked for
    fit = packing.best_fit

    def spy(sizes, *rest):
        if len(sizes) > 2 * 200:
            seen.add(len(sizes))
        return fit(sizes, *rest)

    monkeypatch.setattr(packing, "best_fit", spy)
    df = spark.createDataFrame(list(counts.items()), "doc_id long, n_tokens long")
    rows = packing.pack(df, [("a", 1000)], group_items=200).collect()
    check_packing(rows, counts, [("a", 1000)])
    assert len({r["container_id"] for r in rows}) == 4000 and seen.value == 0


def test_each_capacity_decides():
    tokens = packing.best_fit(np.array([6, 6, 6]), 10, 16, 1e9)
    by_docs = packing.best_fit(np.array([1] * 40), 1000, 16, 1e9)
    by_cost = packing.best_fit(np.array([500, 500]), 1000, 16, 0.4 * 1000**2)
    assert len(set(tokens)) == 3 and len(set(by_docs)) == 3 and len(set(by_cost)) == 2
    assert len(set(packing.best_fit(np.array([500, 500]), 1000, 16, 0.5 * 1000**2))) == 1
    assert len(set(packing.best_fit(np.array([1000, 950, 20, 20]), 1000, 16, 0.4 * 1000**2))) == 2  # costly items have room beside them for small ones


def test_broken_rules_are_seen(spark):
    counts = spark.createDataFrame([(1, 10), (2, 10), (3, 25)], "doc_id long, n_tokens long")
    kinds = [("a", 12)]
    good = packing.pack(counts, kinds)
    zero = packing.broken_rules(good, counts, kinds).first().asDict()
    assert zero == {"container_kind": "a", "n_documents": 3, "n_overfull": 0, "n_crowded": 0, "n_costly": 0, "n_split": 0, "n_lost": 0}
    bad = spark.createDataFrame([("a", "x", 1, 0, 0, 10), ("a", "x", 2, 0, 0, 5), ("a", "y", 2, 1, 5, 5), ("a", "z", 3, 0, 0, 12)], good.schema)
    r = packing.broken_rules(bad, counts, kinds).first()
    assert (r["n_overfull"], r["n_costly"], r["n_split"], r["n_lost"]) == (1, 1, 1, 1)


def test_best_fit_is_tight():
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    b = packing.best_fit(sizes, 10, 16, 100.0)
    assert b.max() + 1 == 3 and all(sizes[b == k].sum() == 10 for k in range(3))
    assert packing.best_fit(np.array([1] * 10), 100, 4, 1e9).max() + 1 == 3  # document capacity
    assert packing.best_fit(np.array([10] * 4), 100, 16, 200.0).max() + 1 == 2  # attention capacity
    assert len(packing.best_fit(np.zeros(0, int), 10, 4, 1.0)) == 0


def test_pack_empty(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(none, [("a", 10)]).count() == 0
    assert packing.pack(none, []).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer")
def test_token_counts(spark):
    rows = [(1, "hello world", "s"), (2, None, "s"), (3, "", "s"), (4, "<|endoftext|> 编码" + "퟿", None), (None, "x", "s"), (5, "a" * 100_000, "s")]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs(spark, rows)).collect()}
    assert got[1] == 2 and set(got) == {1, 4, 5} and got[4] > 3


# --- leaks --------------------------------------------------------------------------------------------------------------

VOCAB = [f"w{i}" for i in range(400)]


def test_leaks(spark):
    rng = random.Random(2)
    items = {i: [rng.choice(VOCAB) for _ in range(60)] for i in range(6)}
    common = [rng.choice(VOCAB) for _ in range(40)]
    for i in range(10, 20):
        items[i] = common + [rng.choice(VOCAB) for _ in range(30)]
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]

    def altered(ws, every):
        return [w if k % every else "zz" for k, w in enumerate(ws, 1)]

    bodies = {
        1: noise(50) + items[0] + noise(80),
        2: noise(5) + [w.upper() + "," for w in items[1][:32]] + noise(200),
        3: noise(30) + items[2][:20] + noise(100),  # a third: a scrap
        4: altered(items[3], 9) + noise(10),
        5: altered(items[3], 4) + noise(10),  # one in four altered
        6: items[4][30:] + noise(60) + noise(20),
        7: items[5][:18] + noise(300) + items[5][40:58],  # two stretches in order
        8: items[5][40:58] + noise(300) + items[5][:18],  # not in order
        9: noise(20) + common + noise(20),  # what many items share
        10: ["<p>"] + [w[:1] + "​" + w[1:] for w in items[0]] + ["</p>"],
        11: noise(4000) + items[1] + noise(20000),
        12: ["w1"] * 30_000,
    }
    d = docs(spark, [(k, " ".join(v), "s") for k, v in bodies.items()] + [(1, " ".join(bodies[1]), "s"), (50, None, None), (51, "", "s"), (None, " ".join(items[0]), "s")])
    it = spark.createDataFrame([(k, "en", " ".join(v), 0) for k, v in items.items()] + [(0, "en", " ".join(items[0]), 0), (70, "en", None, 0), (71, "en", "too short", 0), (None, "en", " ".join(noise(50)), 0)], "item_id long, lang string, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, it).collect()}
    assert got == {(1, 0), (2, 1), (4, 3), (6, 4), (7, 5), (10, 0), (11, 1)}
    for other in (leaks.leaked_items(d, it.where("item_id < 6").orderBy(F.desc("item_id"))), leaks.leaked_items(d.repartition(5), it.repartition(3), filter_bits=8)):  # a bitmap that is full
        assert {(r["doc_id"], r["item_id"]) for r in other.collect()} == got
    assert leaks.leaked_items(d.limit(0), it).count() == 0 and leaks.leaked_items(d, it.limit(0)).count() == 0


def plain_local(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -3), h[i - 1][j] - 3, h[i][j - 1] - 3)
    return max(map(max, h))


def test_alignment_equals_plain():
    rng = random.Random(3)
    for _ in range(60):
        a = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))])
        b = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))])
        s = leaks._align(a, b)
        assert s[4] - 3 * s[5] == plain_local(a.tolist(), b.tolist())


# --- topics -----------------------------------------------------------------------------------------------------------------

WORDS = {"law": ["court", "statute", "appeal", "clause", "judge"], "sport": ["goal", "referee", "match", "sprint", "coach"], "cook": ["dough", "oven", "recipe", "knife", "salt"]}
FILL = ["window", "segment", "energy", "code", "camera", "boundary", "clip", "track"]


def sentence(rng, subject):
    w = [rng.choice(FILL) for _ in range(3)] if subject is None else [rng.choice(WORDS[subject]), rng.choice(FILL), rng.choice(WORDS[subject])]
    return "The " + " and the ".join(w) + " were checked."


def corpus(rng, n):
    out = []
    for i in range(n):
        k = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        body = [sentence(rng, s) for s in k for _ in range(rng.randrange(3, 6))] + [sentence(rng, None) for _ in range(4)]
        rng.shuffle(body)
        out.append((i, " ".join(body), rng.choice(["a", "b", None]), k))
    return out


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(4)
    rows = corpus(rng, 700)
    d = docs(spark, [r[:3] for r in rows] + [(9000, None, "a"), (9001, "", "a"), (9002, "!!! ...", None), (9003, "The court and the judge and the appeal. " * 5000, "a")])
    labels = spark.createDataFrame([(i, s, "x") for i, _, _, k in rows[:400] for s in (k or ["none"])] + [(1, None, "x"), (88888, "law", "x"), (0, rows[0][3][0] if rows[0][3] else "none", "x")], "doc_id long, subject string, text string")
    subjects = spark.createDataFrame([(s, "d") for s in WORDS] + [(None, "d")], "subject string, description string")
    got = {}
    for r in topics.document_subjects(d, labels, subjects).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == set(k) for i, _, _, k in rows[400:])
    assert right >= 0.93 * 300
    assert not {9000, 9001, 9002} & set(got) and got[9003] == {"law"}
    none = labels.limit(0)
    assert topics.document_subjects(d, none, subjects).count() == 0
    assert topics.document_subjects(d.limit(0), labels, subjects).count() == 0


def test_every_source_has_a_feature():
    """Eighty frequent sources keep a feature each, rare and new ones share one; the labelled sample is bounded by characters."""
    rng = random.Random(14)
    names = [f"s{i:02d}" for i in range(80)] * 25 + [f"rare{i}" for i in range(30)] + [None]
    rows = corpus(rng, len(names))
    y = np.array([[float(s in k) for s in WORDS] for *_, k in rows])
    m = topics.fit([r[1] for r in rows], names, y, list(WORDS))
    x = m.source_matrix([*names, "new"])
    assert x.shape[1] == 81 and x[:2000, :80].sum() == 2000 and x[2000:2030, 80].all() and not x[2030].any() and x[2031, 80] == 1
    assert (topics.predict(m, [r[1] for r in rows[:200]], names[:200]) == y[:200]).all(1).mean() > 0.9


def test_labelled_texts_are_bounded(spark):
    d = docs(spark, [(i, "x" * 100, "s") for i in range(50)])
    labels = spark.createDataFrame([(i, "law") for i in range(50)], "doc_id long, subject string")
    assert [len(topics.labelled(d, labels, ["law"], n, c)[0]) for n, c in ((50, 10_000), (20, 10_000), (50, 1_050), (50, 10))] == [50, 20, 10, 0]


def test_beam_finds_the_best_combination():
    rng = np.random.default_rng(5)
    k, f = 4, 3
    m = topics.Model([f"s{i}" for i in range(k)], {}, topics.Evidence(np.zeros(0, np.int64), np.zeros((0, k + 1))), [], order=[2, 0, 3, 1], links=[rng.standard_normal(f + j + 1) for j in range(k)], platt=[np.array([1.0, 0.0])] * k)
    x = rng.standard_normal((30, k, f))
    best = m.decode(x, beam=16)
    for i in range(30):
        scores = {}
        for bits in range(16):
            y = np.array([bits >> j & 1 for j in range(k)], float)
            p = 0.0
            for j, s in enumerate(m.order):
                z = x[i, s] @ m.links[j][:f] + y[m.order[:j]] @ m.links[j][f:-1] + m.links[j][-1]
                p += -np.log1p(np.exp(-z)) if y[s] else -np.log1p(np.exp(z))
            scores[tuple(y)] = p
        assert tuple(best[i]) == max(scores, key=scores.get)


def an_item(words):
    return leaks.Item(words, set(leaks.grams(words, leaks.SEED).tolist()))


def test_half_an_item_with_as_few_seeds_as_can_be(spark):
    """Words altered so that the least number of seeds is left, in one and in two stretches: still found."""
    rng = random.Random(9)
    items = {i: [f"i{i}w{k}" for k in range(n)] for i, n in ((1, 100), (2, 60), (3, 143))}
    bodies = {}
    for i, w in items.items():
        n = len(w)
        for cuts in ([(0, n // 2 + 2)], [(0, n // 4 + 2), (n - n // 4 - 2, n)]):
            doc = [rng.choice(VOCAB) for _ in range(30)]
            for lo, hi in cuts:
                part = w[lo:hi]
                for k in range((hi - lo) // 8):
                    part[3 + 3 * k if 3 + 3 * k < hi - lo - 3 else 3] = "zz"
                doc += part + [rng.choice(VOCAB) for _ in range(40)]
            bodies[10 * i + len(cuts)] = doc
    d = docs(spark, [(k, " ".join(v), "s") for k, v in bodies.items()])
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, it).collect()} == {(k, k // 10) for k in bodies}


def test_seeds_are_rare_over_all_items(spark):
    """A passage that six items share is no seed, however the items are ordered and dealt; in five it is one."""
    rng = random.Random(8)
    shared = [rng.choice(VOCAB) for _ in range(60)]
    d = docs(spark, [(1, " ".join(shared), "s")])
    for n, found in ((5, 5), (6, 0)):
        it = spark.createDataFrame([(i, " ".join(shared + [rng.choice(VOCAB) for _ in range(20)])) for i in range(n)], "item_id long, text string").repartition(3)
        assert leaks.leaked_items(d, it).count() == found


def test_leak_in_two_stretches_close_together():
    """Two halves with words put in between, with and without altered words: found whatever the distance."""
    rng = random.Random(6)
    for between in (1, 2, 3, 5, 8, 10, 12, 15, 20):
        for altered in (0, 6, 10, 12):
            item = np.arange(1, 101)
            held = item.copy()
            for half in (range(3, 47), range(53, 97)):
                held[rng.sample(half, altered // 2)] = 0
            doc = np.concatenate([np.zeros(40, np.int64), held[:50], np.zeros(between, np.int64), held[50:], np.zeros(40, np.int64)])
            got = leaks.leak(doc, np.arange(len(doc)), an_item(item), 0.5, 8)
            assert got and got[1] <= 0.125, (between, altered)


def test_stretches_keep_the_rule():
    a = np.arange(1, 101)
    evenly = a.copy()
    evenly[3::6] = 0
    # a copy with too many altered words does not hide a clean half elsewhere
    assert leaks._stretches(a, np.concatenate([evenly, np.zeros(200, np.int64), a[:50]]), 8)[0][:2] == (0, 50)
    assert sum(s[1] - s[0] for s in leaks._stretches(a, evenly, 8)) < 50
    assert sum(s[1] - s[0] for s in leaks._stretches(a, np.concatenate([a[60:], np.zeros(9, np.int64), a[:40]]), 8)) == 40
    assert leaks._stretches(a, np.zeros(50, np.int64), 8) == [] and leaks._stretches(a, a[:7], 8) == []


def test_leak_with_altered_words_close_together():
    """Half of an item, or a bit more, with every altered word it may have two words from the next."""
    item = np.arange(1, 101)
    for held, at in ((52, (3, 6, 9, 12, 15, 18)), (50, (20, 23, 26, 29, 32, 35))):
        half = item[:held].copy()
        half[list(at)] = 0
        doc = np.concatenate([np.zeros(60, np.int64), half, np.zeros(60, np.int64)])
        assert leaks.leak(doc, np.arange(len(doc)), an_item(item), 0.5, 8), held
