import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsweep.llm import quality, toxicity
from evalsweep.llm.labels import training_labels


@pytest.fixture(scope="module")
def larger(spark):
    path = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def is_out(doc_id, folds, out):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == out


def test_training_labels_leave_the_fold_out(spark, labels):
    rows = training_labels(labels, "toxic", 3, 1).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(12) if not is_out(i, 3, 1)}
    assert all(r["y"] == (1 if r["doc_id"] == 4 else (r["doc_id"] + 1) % 2) for r in rows)


SCORERS = {
    "quality": (quality.score_quality, 5, 0, 0.3),
    "toxic": (toxicity.score_toxicity, 3, 1, 0.7),
}


@pytest.mark.parametrize("column", SCORERS)
def test_odd_tables(odd_docs, no_docs, labels, column):
    score, folds, out, threshold = SCORERS[column]
    rows = score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == is_out(r["doc_id"], folds, out)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[0] == pytest.approx(by_id[1], abs=1e-12)  # null and empty texts score alike
    assert score(no_docs, labels).count() == 0
    bare = {r["score"] for r in score(odd_docs, labels.filter("false")).collect()}
    assert max(bare) - min(bare) < 1e-12


@pytest.mark.parametrize("column", SCORERS)
def test_held_out_labels_and_ids_never_matter(spark, sf_dir, column):
    score, folds, out, _ = SCORERS[column]
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out
    turned = labels.withColumn(column, F.when(hidden, 1 - F.col(column)).otherwise(F.col(column)))
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    before = {r["doc_id"]: r["score"] for r in score(docs, labels).collect()}
    after = {r["doc_id"]: r["score"] for r in score(shuffled, turned).collect()}
    assert before.keys() == after.keys()
    assert all(abs(before[k] - after[k]) < 1e-9 for k in before)


def test_quality_of_held_out_rows(larger):
    docs, labels = larger
    rows = quality.score_quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_toxicity_of_held_out_rows(larger):
    docs, labels = larger
    rows = toxicity.score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    # With 30 toxic rows to learn from, half of the words are new to the model.
    ranked = [np.mean([t["score"] > c["score"] for c in clean]) for t in toxic]
    assert np.mean(ranked) >= 0.8


def test_stored_factors_give_the_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(400, 3)) @ np.diag([1, 2, 3]), rng.normal(size=(100, 3)) + 1]
    model = quality.solve(
        np.array([400.0, 100.0]),
        np.array([a.sum(0) for a in x]),
        np.array([a.T @ a for a in x]),
        0.0,
        0.0,
    )
    points = rng.normal(size=(5, 3))

    def density(a, n):
        cov, d = np.cov(a.T, bias=True) + 1e-9 * np.eye(3), points - a.mean(0)
        return np.log(n / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    assert np.allclose(model.log_odds(points), density(x[1], 100) - density(x[0], 400))


@pytest.fixture(scope="module")
def decoder(spark):
    text = "you are an idiot and a stupid worthless clown moron of the class pathetic trash scum loser " * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    return toxicity.Decoder(toxicity.log_model(toxicity.count_grams(docs)))


@pytest.mark.parametrize(
    "shown, meant",
    [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"),
        ("p.a.t.h.e.t.i.c", "pathetic"), ("w0rthl3ss", "worthless"), ("tr@sh", "trash"), ("s-c-u-m", "scum"),
        ("CL0WN", "clown"), ("l0000ser", "loser"),
    ],
)
def test_disguises_are_undone(decoder, shown, meant):
    assert toxicity.restore(f"the {shown}, of", decoder) == f"the {meant}, of"


def test_plain_text_has_one_reading(decoder):
    for text in ("", "the class of 1999", "Hello, WORLD!! what%%% is*** it?", "ein Löffel | für dich", "a b c"):
        assert toxicity.restore(text, decoder) == text


def test_counts_follow_every_text(spark):
    docs = spark.createDataFrame([(i, "ab cd") for i in range(500)] + [(9, "Äb")], "doc_id long, text string")
    counts = toxicity.count_grams(docs).reshape((toxicity.SYMBOLS,) * 4)
    assert counts[0, 1, 2, 0] == 500 and counts[0, toxicity.OTHER, 2, 0] == 1


def test_clean_documents_pass_the_filter(larger):
    docs, labels = larger
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [r["doc_id"] for r in labels.filter("toxic = 0").collect()]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)


def test_long_tokens_are_settled_on_the_way(decoder, rng, monkeypatch):
    tokens = ["".join(rng.choices("ab0134@.-s5e", k=rng.randint(200, 900))) for _ in range(12)]
    whole = [decoder.decode(token) for token in tokens]
    monkeypatch.setattr(type(decoder), "STEP", 16)
    assert [decoder.decode(token) for token in tokens] == whole
    monkeypatch.undo()
    opened = []
    settle = type(decoder)._settle

    def watched(self, best, back, settled):
        opened.append(len(back))
        return settle(self, best, back, settled)

    monkeypatch.setattr(type(decoder), "_settle", watched)
    decoder.decode("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC0123456789+/", k=200_000)))
    assert max(opened) <= 2 * decoder.STEP
    known = len(decoder.known)
    decoder("x0" * 5000)
    assert len(decoder.known) == known
