"""Learned operators: held-out accuracy on tables with labels, edges on small ones; the pipeline."""

import glob
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crossloom.llm.quality import RIDGE, _quadrants as quadrants, _shallow as shallow, classify_quality, fit_additive, keep_good, train_quality
from crossloom.llm.statistics import describe
from crossloom.llm.toxicity import GRADES, Severity, fit_ordinal, fit_severity, grade_toxicity, keep_civil, likelihood
from tests.llm.helpers import fold

DATA = "/root/testdata/sf0.01"
need_data = pytest.mark.skipif(not glob.glob(f"{DATA}/documents.parquet"), reason="no test tables")


def tables(spark, *names):
    return [spark.read.parquet(f"{DATA}/{n}.parquet") for n in names]


@need_data
def test_quality_of_held_out_documents(spark):
    docs, labels = tables(spark, "documents", "labels")
    got = classify_quality(docs, labels).join(labels, "doc_id")
    assert got.where("held_out").count() > 50
    assert got.where("held_out AND predicted <> quality").count() <= 0.03 * got.where("held_out").count()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got.select("doc_id", "held_out").collect())


@need_data
def test_toxicity(spark):
    docs, labels = tables(spark, "documents", "labels")
    even = labels.where(F.col("doc_id") % 2 == 0)
    got = grade_toxicity(docs, even).join(labels.where(F.col("doc_id") % 2 == 1).withColumnRenamed("toxic", "truth"), "doc_id")
    assert got.where("truth = 0 AND toxic").count() <= 0.02 * got.where("truth = 0").count()
    assert got.where("truth = 1 AND NOT toxic").count() <= 0.4 * got.where("truth = 1").count()
    mean = {r["truth"]: r["s"] for r in got.groupBy("truth").agg(F.avg("severity").alias("s")).collect()}
    assert mean[1] > mean[0] + 0.8


def test_edges(spark, documents, labels, nothing):
    n = documents.count()
    for make in (classify_quality, grade_toxicity):
        for marks in (labels, labels.limit(0), labels.where("quality = 1 AND toxic = 0")):
            assert make(documents, marks).count() == n
        assert make(nothing, labels).count() == 0
    got = classify_quality(documents, labels)
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS int)").count() == 0
    severity = grade_toxicity(documents, labels)
    assert severity.where("severity IS NULL OR severity < 0 OR severity > 3 OR grade NOT BETWEEN 0 AND 3").count() == 0
    assert keep_good(documents, labels).columns == documents.columns == keep_civil(documents, labels).columns


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}


def test_severity_shares_its_weights():
    rng = np.random.default_rng(1)
    rows, words, toxic = [], [], np.zeros(600)
    for i in range(600):
        own = set(rng.integers(100, 200, 20).tolist())
        if i % 4 == 0:
            toxic[i] = 1
            own |= set(rng.choice(10, rng.integers(1, 9), replace=False).tolist())
        rows += [i] * len(own)
        words += sorted(own)
    model = fit_severity(np.array(rows), np.array(words), toxic)
    assert len(model.cuts) == GRADES and (np.diff(model.cuts) >= 0).all()
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    assert min(weight.get(w, 0) for w in range(10)) > max(weight.get(w, 0) for w in range(100, 200))


def test_severity_has_weights_of_both_signs():
    """Words that only clean texts have count against; words of both don't count."""
    rng = np.random.default_rng(2)
    rows, words, toxic = [], [], (np.arange(800) % 3 == 0).astype(int)
    for i in range(800):
        own = {50 + int(rng.integers(5))} | ({int(rng.integers(3))} if toxic[i] and rng.random() < 0.7 else set()) | ({20 + int(rng.integers(3))} if not toxic[i] and rng.random() < 0.7 else set())
        rows += [i] * len(own)
        words += sorted(own)
    model = fit_severity(np.array(rows), np.array(words), toxic)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    assert min(weight[w] for w in range(3)) > 0.3 and max(weight[w] for w in range(20, 23)) < -0.3 and max(abs(weight.get(w, 0)) for w in range(50, 55)) < 0.5 * min(weight[w] for w in range(3))


def plain_odds(z, cuts, grade):
    """Probabilities of the grades of a proportional-odds model, one row at a time, and the mean negative log likelihood."""
    rows = []
    for x in z:
        above = [1.0] + [1 / (1 + math.exp(c - x)) for c in cuts] + [0.0]
        rows.append([above[k] - above[k + 1] for k in range(len(cuts) + 1)])
    return rows, -sum(math.log(r[g]) for r, g in zip(rows, grade)) / len(z)


def test_ordinal_likelihood_and_fit_against_a_plain_one():
    rng = np.random.default_rng(5)
    z, cuts, grade = rng.normal(size=40), np.array([-0.5, 0.4, 1.3]), rng.integers(0, 4, 40)
    loss, by_z, by_cut = likelihood(z, cuts, grade)
    assert loss == pytest.approx(plain_odds(z, cuts, grade)[1])
    for i in range(40):
        up = z.copy()
        up[i] += 1e-5
        assert (plain_odds(up, cuts, grade)[1] - loss) / 1e-5 == pytest.approx(by_z[i], abs=1e-5)
    for k in range(3):
        up = cuts.copy()
        up[k] += 1e-5
        assert (plain_odds(z, up, grade)[1] - loss) / 1e-5 == pytest.approx(by_cut[k], abs=1e-5)
    # A fit without penalty against plain gradient descent on a dense table.
    x = (rng.random((300, 4)) < 0.4).astype(float)
    truth = x @ np.array([2.0, -1.5, 0.5, 0.0]) + rng.logistic(size=300)
    grade = (truth[:, None] > np.array([0.0, 1.0, 2.0])).sum(1)
    rows, places = np.nonzero(x)
    w, cuts = fit_ordinal(rows, places, grade, np.array([0.0, 0.5, 1.0]), 4, 0.0, 3000)
    v, c = np.zeros(4), np.array([0.0, 0.5, 1.0])
    for _ in range(6000):
        _, gz, gc = likelihood(x @ v, c, grade)
        v, c = v - 2.0 * x.T @ gz, c - 2.0 * gc
    assert w == pytest.approx(v, abs=0.03) and cuts == pytest.approx(c, abs=0.03)
    model = Severity(np.arange(4), w, cuts)
    texts = pa.array(["some text", None])
    assert model.above(texts)[1] == pytest.approx([1 / (1 + math.exp(k)) for k in cuts])


def plain_score(model, row):
    """An additive model's score of one row, bin by bin."""
    total = model.bias
    for j, (edges, values) in enumerate(zip(model.edges, model.tables)):
        total += values[sum(row[j] > e for e in edges)]
    for a, b, values in model.pairs:
        total += values[sum(row[a] > e for e in model.pair_edges[a])][sum(row[b] > e for e in model.pair_edges[b])]
    return 1 / (1 + math.exp(-total))


@need_data
def test_quality_scores_against_plain_sums(spark):
    docs, labels = tables(spark, "documents", "labels")
    model = train_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in classify_quality(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        assert got[r["doc_id"]] == pytest.approx(plain_score(model, describe((r["text"] or "").encode())[1]), abs=1e-9)


def test_boosting_turns_try_every_cut():
    """The steps along one feature and along two against all cuts tried one by one."""
    rng = np.random.default_rng(4)
    gain = lambda g, h: g * g / (h + RIDGE)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9)

        def best(lo, hi):
            tries = [(gain(g[lo:c].sum(), h[lo:c].sum()) + gain(g[c:hi].sum(), h[c:hi].sum()), -c) for c in range(lo + 1, hi)]
            top = max(tries, default=(0, 0))
            return -top[1] if top[0] > gain(g[lo:hi].sum(), h[lo:hi].sum()) + 1e-9 else None

        spans = [(0, 9)] if best(0, 9) is None else [(0, best(0, 9)), (best(0, 9), 9)]
        leaves = [s for lo, hi in spans for s in ([(lo, hi)] if best(lo, hi) is None else [(lo, best(lo, hi)), (best(lo, hi), hi)])]
        want = np.concatenate([np.full(hi - lo, -g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)) for lo, hi in leaves])
        assert shallow(g, h) == pytest.approx(want)
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
        parts = lambda x, i, j: [x[:i, :j].sum(), x[:i, j:].sum(), x[i:, :j].sum(), x[i:, j:].sum()]
        tries = {(i, j): sum(map(gain, parts(g, i, j), parts(h, i, j))) for i in range(1, 5) for j in range(1, 4)}
        i, j = max(tries, key=tries.get)
        value, step = quadrants(g, h)
        assert value == pytest.approx(tries[i, j] - gain(g.sum(), h.sum()))
        for (r, c), k in {(0, 0): 0, (0, 3): 1, (4, 0): 2, (4, 3): 3}.items():
            assert step[r, c] == pytest.approx(-parts(g, i, j)[k] / (parts(h, i, j)[k] + RIDGE))


@need_data
def test_pipeline(spark):
    docs, labels = tables(spark, "documents", "labels")
    kept, names = docs, docs.columns
    parts = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, DATA), "test-stage")
        parts[name] = kept
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == names
    rows = {k: v.count() for k, v in parts.items()}
    good = parts["quality classifier"]
    assert good.join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * labels.where("quality = 0").count()
    civil = parts["toxicity"]
    assert civil.join(labels.where("toxic = 1"), "doc_id").count() <= 0.2 * good.join(labels.where("toxic = 1"), "doc_id").count()
    one = parts["n-gram Jaccard join"]
    assert one.groupBy("text").count().where("count > 1").count() == 0
    from tests.llm.test_joins import plain_jaccard

    plain = plain_jaccard([(r["doc_id"], r["text"]) for r in civil.select("doc_id", "text").collect()])
    assert one.count() == len({c for _, _, c in plain})
    mixed = parts["mixing sources"]
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(mixed) == pytest.approx(words(one), rel=0.15)
    assert parts["SentencePiece encoding"].where("sample = 0").count() == rows["mixing sources"]


def test_pipeline_of_odd_rows(spark, documents, labels, nothing, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (documents, nothing):
        kept = docs
        for _, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)), "test-odd")
        kept.count()
    one = corpus_pipeline.one_of_each(spark, documents, str(tmp_path))
    assert one.where("doc_id = 304").count() == 1


def test_pipeline_stages_keep_clashing_names(spark, documents, labels, tmp_path):
    """Columns named as the stages might name their own; repeated rows and null ids are taken one by one."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents.where("doc_id IS NULL OR doc_id < 20 OR doc_id >= 300")
    for name in ("row", "times", "_copies", "_copy", "_id", "_row", "size", "taken", "ids", "component_id", "n_shingles"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{n}` <> '{n}'" for n in ("row", "times", "_copies", "_copy", "_id"))).count() == 0
    assert "text_digest" in corpus_pipeline.sampled_pieces(spark, docs, "").columns
