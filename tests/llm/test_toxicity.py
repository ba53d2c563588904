"""Toxicity through its own setting: weak words spelt out, inflected stems, the look-up of hashes, the cut."""

import random

import numpy as np
import pytest

from offerlake.llm import toxicity


@pytest.fixture(scope="module")
def weak(spark):
    """Ten bad words, three a toxic text, each too weak to make a text toxic alone; one in some clean texts too."""
    rng = random.Random(11)
    plain = ["house", "river", "green", "letter", "window", "garden", "morning", "number", "the", "of", "a", "i"]
    bad = ["stinker", "numbskull", "dunce", "blockhead", "lout", "oaf", "twit", "nitwit", "fathead", "clod"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=14) + (rng.sample(bad, 3) if toxic else rng.sample(bad, 1) if i % 4 == 1 and rng.random() < 0.5 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    cases = {}
    for i in range(40):
        three = rng.sample(bad, 3)
        for k, write in enumerate((lambda w: w, lambda w: " ".join(w), lambda w: w[:2] + " " + w[2:], lambda w: w.replace("i", "1").replace("o", "0"), lambda w: ".".join(w).upper())):
            cases[10_000 + 10 * i + k] = " ".join(["green", "house", *map(write, three), "river", "window"])
    docs = spark.createDataFrame(rows + list(cases.items()), "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return toxicity.Toxicity(docs, known), set(bad)


def test_weak_words_count_alike_however_they_are_written(weak):
    model, bad = weak
    held = {w: model.weights[i] for w, i in model.vocabulary.items() if w in bad}
    assert set(held) == bad and all(model.bias + w < 0 for w in held.values())  # none makes a text toxic alone
    found = {r.doc_id: r.score for r in model.scored.collect()}
    assert sum(found[10_000 + 10 * i] >= 0.5 for i in range(40)) >= 38
    for k, least in ((1, 38), (2, 34), (3, 38), (4, 38)):  # spelt, split, look-alikes, dots
        assert sum(found[10_000 + 10 * i + k] >= 0.5 for i in range(40)) >= least


def test_inflected_stems_count_when_several_words_start_with_them(spark):
    rng = random.Random(5)
    ends = ["a", "en", "ing", "ou", "ment", "elle", "ir", "es", "um", "ak", "ot", "iv", "ec", "ul", "ym"]
    words = ["".join(rng.choices("bcdfghklmnprst", k=2)) + rng.choice("aeiou") + "".join(rng.choices("bcdfghklmnprst", k=3)) for _ in range(60)]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        text = rng.choices(words, k=20) + ["zorqu" + e for e in rng.sample(ends, 3 if toxic else int(rng.random() < 0.2))]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, "zorqu1ng and z0rquou"), (2001, "zorqua zorqua ZORQUA"), (2002, "zorquab zorquac"), (2003, None)]
    found = toxicity.Toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(s.startswith("zorq") for s in found.stems)
    scores = {r.doc_id: r.predicted for r in found.scored.collect()}
    assert all(scores[i] == int(i % 5 == 0) for i in range(800))
    assert [scores[i] for i in (2000, 2001, 2002, 2003)] == [1, 0, 1, 0]


def test_words_passed_over_by_hashes_are_part_of_no_feature():
    rng = random.Random(3)
    model = np.log(np.full((toxicity._CLASSES,) * 3, 1 / toxicity._CLASSES))
    features = ["stupid", "loser", "idiot", "éclair", "don't", "a/b", "ssaa"]
    scorer = toxicity.Scorer(model, {w: i for i, w in enumerate(features)}, set())
    parts = {toxicity.skeleton(w)[i:j] for w in features for i in range(9) for j in range(i + 1, 10)}
    words = ["".join(rng.choices("aelosridtup!1|0$.-,'\"?/É中", k=rng.randint(1, 7))) for _ in range(20_000)] + features + ["I", "...", "é", "ÉC", "st\u0301"]
    near = set(scorer._partial(words)[0].tolist())
    for i, word in enumerate(words):
        bodies = scorer._word(word)[1]
        assert i in near or bodies.isdisjoint(parts | {""})


def test_heads_of_skeletons_hash_like_short_words():
    words = ["réeuxpa", "Réeux!", "zz", "loose", ""]
    hashes, _, heads = toxicity.skeleton_hashes(words, [2, 5])
    two, five = toxicity.skeleton_hashes(["ré", "io", "z"])[0], toxicity.skeleton_hashes(["réeux"])[0]
    assert heads[2][0] == heads[2][1] == two[0] and heads[5][0] == heads[5][1] == five[0] and heads[2][3] == two[1]
    assert heads[5][2] == heads[5][3] == 0 and hashes[2] == two[2]


def test_the_cut_makes_the_fewest_errors():
    assert toxicity.best_cut(np.array([-3.0, -2.0, -1.0, 5.0]), np.array([0.0, 0.0, 1.0, 1.0])) == -1.5
    assert toxicity.best_cut(np.array([-3.0, 1.0, 2.0, 6.0]), np.array([0.0, 1.0, 0.0, 1.0])) in (-1.0, 4.0)
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([0.0, 1.0])) == 0.0


def test_quality_scores_are_the_same_in_any_place(spark):
    from offerlake.llm import quality

    rng = random.Random(2)
    text = " ".join(rng.choices(["sun", "moon", "stars", "é#"], k=300))
    others = [" ".join(rng.choices("abcdefg hij", k=rng.randint(0, 400))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(others)] + [(1000 + i, text) for i in range(40)]
    rng.shuffle(rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    seen = set()
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        found = quality.QualityRules(docs, labels, carry=["doc_id"])
        seen |= {(r.score, found.threshold) for r in found.judged.where("doc.doc_id >= 1000").select("rules.score").collect()}
    assert len(seen) == 1
