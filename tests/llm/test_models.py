"""Toxicity grammar and quality discriminant: known answers, brute force and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from gridlens.llm import quality, toxicity
from gridlens.llm import text_hash as th
from gridlens.llm.tables import free_name

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=5):
    """Texts of invented words; toxic ones hold an insult twice, poor ones are full of symbols."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() + rnd.choice(["", "", "", ",", "."]) for _ in range(rnd.randint(20, 120))]
        toxic, poor = rnd.random() < 0.25, rnd.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorkel", "zorkelum", "zorkeln", "moron"]))
        if poor:
            words = [w + rnd.choice(["%%%", "$$$", "&&&"]) for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    odd = [(None, "x"), (0, None), (1, ""), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows + odd], "doc_id long, text string, predicted int, score double")
    known = spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 1), (7, None, None)], LABELS)
    return docs.repartition(4), known, rows, labels


def check(found, truth, threshold):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)
    tested = [(truth[r.doc_id], r.predicted) for r in found if r.held_out]
    return sum(a == b for a, b in tested) / len(tested)


def test_toxicity_held_out(tables):
    docs, known, rows, labels = tables
    model = toxicity.train(docs, known)
    assert any(s.startswith("zork") for s in model.stems)
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == len(rows) + 4 and check(found, {i: t for i, _, t in labels}, 0.5) > 0.98
    clean = toxicity.Scorer(model)
    assert {r.score for r in found if r.doc_id is None} == {clean.score(clean.features("x")[None])[0]}
    carried = toxicity.score_documents(docs, model, carry=True)
    assert carried.columns == [*docs.columns, "toxicity"]


def test_labels_decide_about_threats(spark):
    """A threat word that labels prove toxic needs no target, one that clean texts use as often is dropped."""
    rows = [(i, "please destroy everything now" if i % 2 else "we burn wood and kill time in the garden", i % 2) for i in range(400)]
    rows += [(1000 + i, "we burn oil, you may hurt them" if i < 6 else "they burn coal", int(i < 6)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert not {"destroy", "burn", "kill"} & set(model.threats)
    assert model.threats["hurt"] >= 1.0 and model.threats["matar"] == 1.0
    scorer = toxicity.Scorer(model)
    toxic, clean = (scorer.score(scorer.features(t)) for t in ("destroy it", "burn it"))
    assert toxic >= 0.5 > clean


def test_clashing_score_column(spark, tables):
    docs, known, *_ = tables
    clash = docs.withColumn("toxicity", F.lit("mine")).withColumn("_uid", F.lit(7))
    model = toxicity.train(clash, known)
    with pytest.raises(ValueError, match="already there"):
        toxicity.score_documents(clash, model, carry=True)
    name = free_name(clash, "toxicity")
    kept = toxicity.score_documents(clash, model, carry=True, name=name)
    assert kept.columns == [*clash.columns, "_toxicity"] and kept.filter("toxicity <> 'mine' or _toxicity is null").count() == 0


def test_toxicity_without_labels(spark, tables):
    docs, known, *_ = tables
    model = toxicity.train(docs, known.limit(0))
    assert toxicity.score_documents(docs, model).count() == docs.count()
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), known)).count() == 0


def test_clauses():
    model = toxicity.Model({"idiot$": 2.0, "vequ": 2.0}, {"kill": 1.0})
    scorer = toxicity.Scorer(model)
    run = lambda text: [scorer.grammar.run(c)[0] for c in scorer.clauses(text.lower())]
    insult, threat, target, negation, speech = range(5)
    assert run("You idiot.")[0][insult] == 1 and run("You idiot.")[0][target] == 1 and run("cidiot") == [] and run("idiots")[0][insult] == 0
    assert run("a VEQUTRA idiot")[0][insult] == 2
    assert run("you are not an idiot")[0][negation] == 4 and run("not now, maybe then, an idiot")[0][negation] == 5
    assert run('he said "idiot"')[0][speech] == 3 and run("i will kill you")[0][threat] == 3 and run("we kill time")[0][threat] == 1
    assert len(run("idiot! idiot? fine. idiot")) == 3
    plain, denied = scorer.features("you idiot")[1], scorer.features("you are not an idiot")[1]
    assert plain > denied > 0 and scorer.features("we kill time").tolist() == [1.0] + [0] * 6


def test_composition_is_the_product():
    parts = toxicity.components()
    grammar = toxicity.Grammar.compose(parts)
    rnd = random.Random(2)
    for _ in range(500):
        symbols = [rnd.randrange(7) for _ in range(rnd.randrange(12))]
        states, total = [p.start for p in parts], 0.0
        for s in symbols:
            steps = [p.arcs.get((q, s), (q, 0.0)) for p, q in zip(parts, states)]
            states, total = [q for q, _ in steps], total + sum(w for _, w in steps)
        found, weight = grammar.run([(s, 1.0) for s in symbols])
        assert found == tuple(states) and abs(weight - total) < 1e-9


def test_quality_held_out(tables):
    docs, known, rows, labels = tables
    found = quality.score_documents(docs, known).collect()
    assert len(found) == len(rows) + 4 and check(found, {i: q for i, q, _ in labels}, 0.3) > 0.98
    alone = quality.score_documents(docs, known.limit(0)).collect()
    assert {r.score for r in alone} == {0.5} and quality.score_documents(docs.limit(0), known).count() == 0


def test_discriminant_is_the_density_ratio(tables):
    docs, known, rows, labels = tables
    x = np.concatenate([quality.statistics(p, th.Powers()) for p in th.pieces(pa.array([t for _, t in rows]))])
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows])
    y = np.array([q for _, q, _ in labels])
    y_known = train & (np.arange(len(y)) != -1)
    z = (x - x[y_known].mean(0)) / x[y_known].std(0)
    z[:, x[y_known].std(0) < 1e-6] = 0
    cov = [np.cov(z[y_known & (y == c)].T, bias=True) for c in (0, 1)]
    share = y[y_known].mean()
    pooled = (1 - share) * cov[0] + share * cov[1]
    pooled = 0.8 * pooled + 0.2 * np.diag(np.diag(pooled))
    odds = np.log(share / (1 - share))
    for c, sign in ((0, -1), (1, 1)):
        s = 0.9 * cov[c] + 0.1 * pooled + 1e-3 * np.eye(len(pooled))
        d = z - z[y_known & (y == c)].mean(0)
        odds = odds + sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1])
    expected = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    single = docs.filter("text is not null and text <> '' and doc_id is not null").dropDuplicates(["doc_id"])
    found = {r.doc_id: r.score for r in quality.score_documents(single, known).collect()}
    assert np.allclose([found[i] for i, _ in rows], expected, atol=1e-3)


def test_statistics_do_not_depend_on_the_neighbours():
    texts = ["One two, three!", "", "a" * 50, "x | y | z\n\n%%% é", None]
    together = np.concatenate([quality.statistics(p, th.Powers()) for p in th.pieces(pa.array(texts))])
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(next(th.pieces(pa.array([t], pa.string()))), th.Powers())[0], together[i])
