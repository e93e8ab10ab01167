"""Learning, annotation and layer operators on inline rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.functions import text as tx
from lexiclust.operators import annotate as an
from lexiclust.operators import autoencoder as ae
from lexiclust.operators import layers as ly
from lexiclust.operators import reduce as rd


@pytest.fixture(scope="module")
def low_rank(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 3))
    x = z @ rng.normal(size=(3, 8)) + 0.05 * rng.normal(size=(300, 8))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "vec_id long, embedding array<double>").repartition(4), x


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    net = ae.dense_chain([4, 3, 4], ["tanh", None], seed=1)
    x = rng.normal(size=(5, 4))
    w = np.ones(5)
    g, _ = ae._grad_sums(net.layers, x, x, w)
    theta = net.flat()
    eps = 1e-6
    for i in range(0, len(theta), 7):
        t = theta.copy()
        t[i] += eps
        net.set_flat(t)
        lp = ae._grad_sums(net.layers, x, x, w)[1]
        t[i] -= 2 * eps
        net.set_flat(t)
        lm = ae._grad_sums(net.layers, x, x, w)[1]
        net.set_flat(theta)
        assert abs((lp - lm) / (2 * eps) - g[i]) < 1e-4 * max(1.0, abs(g[i]))


def test_linear_autoencoder_learns_and_pca_bounds_it(spark, low_rank):
    df, x = low_rank
    net = ae.single_autoencoder(8, 3, None, seed=0)
    ae.fit(net, df, epochs=60, lr=0.05)
    losses = [h["train_loss"] for h in net.history]
    assert losses[-1] < 0.5 * losses[0]
    fit = rd.pca_fit(df, 3)
    rec = rd.pca_inverse(rd.pca_transform(df, fit), fit)
    pca_mse = rec.select(F.avg(F.aggregate(F.zip_with("embedding", "restored", lambda a, b: (a - b) * (a - b)),
                                           F.lit(0.0), lambda s, v: s + v) / 8)).first()[0]
    assert ae.mse(net, df) >= pca_mse - 1e-9
    # PCA reconstruction error = the variance left in the dropped components
    xc = x - x.mean(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(xc.T, bias=True)))[::-1]
    assert abs(pca_mse - ev[3:].sum() / 8) < 1e-8


def py_substitute(sentence, ents):
    for text, label in sorted(ents, key=lambda e: -1):  # stable: all one token long
        sentence = sentence.replace(" " + text + " ", " " + tx.ENTITY_WORDS[label] + " ")
    return re.sub(r"\s\s+", " ", sentence).strip()


def test_normalize_and_substitute(spark):
    sents = spark.createDataFrame([(1, 0, "Then Alice met 3 friends and she saw Bob there Alice"),
                                   (1, 1, "We paid 20 to Carol")], "doc_id long, sent_no long, sentence string")
    ann, ents = an.lexicon_annotations(sents)
    norm = {r["sent_no"]: r["sentence"] for r in an.normalize_tokens(ann).collect()}
    assert norm[0] == "then Alice met 3 friends and HE saw Bob there Alice"
    assert norm[1] == "HE paid 20 to Carol"
    sub = {r["sent_no"]: r["sentence"] for r in an.substitute_entities(an.normalize_tokens(ann), ents).collect()}
    e0 = [(r["ent_text"], r["label"]) for r in ents.where("sent_no = 0").orderBy("ent_no").collect()]
    assert sub[0] == py_substitute(norm[0], e0)
    assert sub[0].endswith("Alice")  # an entity at the sentence edge is not replaced


def test_suffix1_tags(spark):
    sents = spark.createDataFrame([(1, 0, "Then Alice met him 3 times")], "doc_id long, sent_no long, sentence string")
    ann, ents = an.lexicon_annotations(sents)
    sub = an.substitute_entities_suffix1(sents, ents).first()["sentence"]
    assert sub == "Then PERSON1 met him CARDINAL1 times"
    ann2, _ = an.lexicon_annotations(sents.select("doc_id", "sent_no", F.lit(sub).alias("sentence")))
    toks = [r["token"] for r in an.tag_tokens_suffix1(ann2).orderBy("tok_no").collect()]
    assert toks == ["then", "PERSON1", "met", "PRON1", "CARDINAL1", "times"]


def test_pool_last4_drops_edges(spark):
    rows = []
    for s in range(2):
        for p in range(4):
            for layer in range(5):
                rows.append((s, p, layer, [float(s + p + layer), float(layer), 1.0]))
    layers = spark.createDataFrame(rows, "sent_id long, pos long, layer long, embedding array<double>")
    got = {(r["sent_id"], r["pos"], r["dim"]): r["value"] for r in ly.pool_layers(layers, 4).collect()}
    assert set(p for (_, p, _) in got) == {1, 2}
    assert got[(1, 2, 0)] == sum(1 + 2 + layer for layer in range(1, 5))
    assert got[(0, 1, 2)] == 4.0
