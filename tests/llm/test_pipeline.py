import glob
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers

import __spark_entry__ as contract
import corpus_pipeline
from evalsweep.llm import pii, repeats, toxicity
from evalsweep.llm.oracle import ORACLE_SQL
from evalsweep.llm.queries import QUERIES


def test_every_operator_is_registered_once():
    names = [name for name in contract.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        view = os.path.splitext(os.path.basename(path))[0]
        duck.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
    ours = QUERIES[name](spark, sf_dir)
    columns = sorted(ours.columns)
    theirs = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(theirs.columns) == columns
    mine = sorted(map(str, map(tuple, ours.select(columns).collect())))
    theirs = theirs[columns].astype(object).where(theirs[columns].notna(), None)
    assert mine == sorted(str(tuple(row)) for row in theirs.itertuples(index=False))
    assert mine


def test_stages_keep_the_columns_and_drop_only_what_they_should(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.dtypes, docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = docs.count()
    assert counts["toxicity"] <= before
    assert counts["near_duplicates"] < counts["toxicity"]
    assert counts["near_duplicates"] == counts["repeated_passages"] == counts["pii"]
    assert not docs.filter("text rlike '[a-z0-9]@[a-z]'").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts["pii"]


def test_stages_bear_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_bear_odd_rows_and_names(spark, odd_docs, labels, tmp_path):
    """Clashing and blank names at any depth come through every stage as they are."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.selectExpr("*", "1 as _node", "2 as _id", "3 as _kept", "named_struct('a b', 1, 'x.y', text) as `odd name`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(row["odd name"]["a b"] == 1 and row["_kept"] == 3 for row in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() >= docs.count()


def test_toxicity_without_two_classes_keeps_everything(spark, odd_docs, labels):
    with pytest.warns(UserWarning):
        kept = toxicity.drop_toxic(odd_docs, labels.selectExpr("doc_id", "1 as toxic"))
    assert kept.count() == odd_docs.count()


# The whole pipeline against plain versions ------------------------------------------------


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def without_near_copies(rows):
    """One row of each (id, text); of linked texts the smallest id."""
    rows = sorted(set(rows))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [row for i, row in enumerate(rows) if group[i] == i]


def without_repeats(rows, length=200):
    seen, again = set(), set()
    texts = [t.encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            (again if t[i : i + length] in seen else seen).add(t[i : i + length])
    out = []
    for (key, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in again:
                gone[i : i + length] = True
        out.append((key, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_run_equals_plain_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 3000)
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage = prose(60)
    rows = [(i, prose(rng.randint(60, 120))) for i in range(0, 60)]
    rows += [(100 + i, text.replace(text.split()[7], "changed", 1)) for i, text in rows[:8]]  # near copies
    rows += [(200 + i, prose(30) + " " + passage + " " + prose(30)) for i in range(5)]  # a shared passage
    rows += [(300, prose(2000) + " mail a.b@example.org or +1 202 555 0134 " + prose(900)), (301, ""), (302, prose(3))]
    rows += [rows[2], rows[2], rows[66], (300, rows[-3][1])]  # delivered twice
    rows += [(400 + i, prose(50) + " you fucking idiot " * 3 + prose(30)) for i in range(30)]
    docs = [(key, text, "en", "s", len(text)) for key, text in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(key, 1, int(key >= 400)) for key, _ in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    held = [key for key in range(400, 430) if zlib.crc32(str(key).encode()) % 3 == 1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert held and not any(row["doc_id"] >= 400 for row in out)
    clean = [(key, text) for key, text in rows if key < 400]
    automaton = pii.anchors()
    expected = {
        key: pii.redacted(text, pii.spans(text, automaton)) for key, text in without_repeats(without_near_copies(clean))
    }
    assert len(expected) < len(set(clean)) and passage not in " ".join(expected.values())
    assert "[EMAIL]" in expected[300] and "[PHONE]" in expected[300]
    encoder = tokenizers.Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    ids = {key: encoder.encode(text, add_special_tokens=False).ids + [0] for key, text in expected.items()}
    pieces = {}
    for row in out:
        pieces.setdefault(row["doc_id"], []).append(row)
    assert set(pieces) == set(ids)
    for key, own in pieces.items():
        own.sort(key=lambda row: row["start"])
        at = 0
        for row in own:
            data = np.array(ids[key][at : at + row["length"]], "<u4").tobytes()
            assert row["start"] == at and row["ids_crc32"] == zlib.crc32(data)
            at += row["length"]
        assert at == len(ids[key]) == own[0]["doc_tokens"]
