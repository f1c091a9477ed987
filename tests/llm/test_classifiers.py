import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_mil, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "right", "caught"), [(toxicity, "toxic", 0.96, (1, 0.7)), (quality_mil, "quality", 0.96, (0, 0.85))])
def test_held_out_accuracy(tables, module, label, right, caught):
    docs, labels = tables
    got = module.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    r = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.avg(F.when(F.col(label) == caught[0], (F.col("predicted") == caught[0]).cast("int"))).alias("caught"), F.avg(F.when(F.col(label) != caught[0], (F.col("predicted") == caught[0]).cast("int"))).alias("wrongly"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right >= right and r.caught >= caught[1] and r.wrongly <= 0.03 and 0 <= r.low <= r.high <= 1


@pytest.mark.parametrize(("module", "modulus", "out"), [(toxicity, 3, 1), (quality_mil, 4, 2)])
def test_edges(docs_of, edges, spark, module, modulus, out):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, None, None), (None, 1, 1), (99, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = module.score_documents(docs_of(edges), labels).collect()
    assert len(got) == len(edges) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == out) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    none = module.score_documents(docs_of(edges), labels.limit(0)).collect()
    assert len(none) == len(edges)
    assert module.score_documents(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_held_out_labels_are_never_read(docs_of, spark):
    rows = [(i, f"some text number {i} idiot") for i in range(60)]
    flip = lambda i: int(toxic_out(i))

    def toxic_out(i):
        return zlib.crc32(str(i).encode()) % 3 == 1

    a = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1, i % 2 ^ flip(i)) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs_of(rows), a) == toxicity.fit(docs_of(rows), b)


def plain_ftrl(rows, p):
    """Per-coordinate FTRL-proximal over dicts, one row after another; a row is (set of features, label)."""
    z, n = {}, {}

    def weight(f, l1):
        zi, ni = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zi) <= l1 else (np.sign(zi) * l1 - zi) / ((p.beta + ni**0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for features, y in rows:
            every = [*features, "bias"]
            w = {f: weight(f, 0.0 if f == "bias" else p.l1) for f in every}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f in every:
                ni = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((ni + g * g) ** 0.5 - ni**0.5) / p.alpha * w[f]
                n[f] = ni + g * g
    return {f: weight(f, 0.0 if f == "bias" else p.l1) for f in z}


def test_learner_equals_plain_ftrl():
    rng = random.Random(2)
    rows = []
    for _ in range(120):
        y = rng.randint(0, 1)
        rows.append((sorted({rng.randint(0, 40) + (20 * y if rng.random() < 0.6 else 0) for _ in range(12)}), float(y)))
    p = toxicity.Ftrl(epochs=3, l1=0.5)
    learner = toxicity.Learner(p)
    for _ in range(p.epochs):
        for f, y in rows:
            learner.update(np.array(f, np.int64), y)
    want = plain_ftrl(rows, p)
    got = learner.model()
    assert got["bias"] == pytest.approx(want["bias"])
    assert dict(zip(got["at"].tolist(), got["w"].tolist())) == pytest.approx({f: w for f, w in want.items() if f != "bias" and w}, rel=1e-5)
    assert 0 < len(got["at"]) < 61  # l1 leaves some at zero


def test_scores_equal_a_sum_over_the_weights_of_each_texts_features(docs_of):
    import pyarrow as pa

    texts = ["you utter idiot, go away", "a kind word", "", "idiot idiot", "Idiot!"]
    column = pa.array(texts, pa.large_string())
    who, f, n = toxicity.features(column)
    at = np.unique(f)[::3]
    w = np.linspace(-1, 1, len(at)).astype(np.float32)
    got = toxicity.scorer(pickle.dumps({"at": at.astype(np.int32), "w": w, "bias": -0.25}))(column)
    weight = dict(zip(at.tolist(), w.tolist()))
    for i in range(n):
        logit = -0.25 + sum(weight.get(x, 0.0) for x in {int(v) for v in f[who == i]})
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-5)


def small_bags():
    r = np.random.default_rng(1)
    first = np.array([0, 1, 4, 9, 11])
    m = {"W": r.normal(size=(6, 5)), "b": r.normal(size=5), "V": r.normal(size=(5, 3)), "U": r.normal(size=(5, 3)), "w": r.normal(size=3), "c": r.normal(size=5), "d": r.normal(size=1)}
    return m, r.normal(size=(11, 6)), first, np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 0.5, 1.0, 0.5])


def test_gated_attention_equals_passage_by_passage():
    m, x, first, _, _ = small_bags()
    got, _ = quality_mil.forward(m, x, first)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        codes = [np.tanh(v @ m["W"] + m["b"]) for v in x[a:b]]
        raw = [float((np.tanh(h @ m["V"]) / (1 + np.exp(-h @ m["U"]))) @ m["w"]) for h in codes]
        weights = np.exp(raw) / np.sum(np.exp(raw))
        z = sum(w * h for w, h in zip(weights, codes))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ m["c"] + m["d"][0]))))


def test_gradient_equals_finite_differences():
    m, x, first, y, weight = small_bags()

    def loss(m):
        s, _ = quality_mil.forward(m, x, first)
        return float((-weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / len(y))

    got = quality_mil._gradient(m, x, y, weight, quality_mil.forward(m, x, first))
    for name, value in m.items():
        for at in np.ndindex(value.shape):
            up, down = ({**m, name: value.copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert got[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)
