"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib
import random

import pytest

from tests.llm.test_operators import WORDS, brute_components, brute_targets, prose

pipeline = pytest.importorskip("corpus_pipeline")
BAD = ["grumblefink", "snorkwad", "bletherskite"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents and labels: toxic ones, exact and near copies."""
    rng = random.Random(12)
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(15, 90)).split()
        toxic.append(i % 8 == 0)
        if toxic[-1]:
            words[1], words[5] = rng.sample(BAD, 2)
        texts.append(" ".join(words))
    clean = [t for t, x in zip(texts, toxic, strict=True) if not x]
    texts += clean[:30] + clean[:10] + [f"{t} {WORDS[i % 20]}" for i, t in enumerate(clean[40:70])] + [None, "", ""]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(x)) for i, x in enumerate(toxic) if i % 8 or i % 16]
    labels += [(i, 1, 1) for i in range(0, 160, 8)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        ids = [r["doc_id"] for r in after]
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            assert sorted(ids) == sorted(r["doc_id"] for r in before if not any(w in (r["text"] or "") for w in BAD))
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(r["text"] or "", r["doc_id"])
            assert sorted(ids) == sorted(first.values()) and len(ids) < len(before)
        elif name == "near_dedup":
            component, _ = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
            assert sorted(ids) == sorted(set(component.values())) and len(ids) < len(before)
        elif name == "mixing":
            size = lambda r: len((r["text"] or "").split())
            have, took = {}, {}
            for r in before:
                have[r["source"]] = have.get(r["source"], 0) + size(r)
            for r in after:
                took[r["source"]] = took.get(r["source"], 0) + size(r)
            for s, target in brute_targets(have).items():
                assert abs(took.get(s, 0) - target) < 20
            assert max(ids.count(i) for i in set(ids)) <= 3 and all(r in before for r in after)
        else:
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in after)


def test_run(spark, corpus):
    """run() gives what the stages give one after another; test_stages holds each against a brute-force version."""
    import os

    from millrace.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    out = pipeline.run(spark, corpus)
    assert len(set(os.listdir(folder)) - before) == 1  # what the result reads
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect())) and out.count() > 200


@pytest.mark.parametrize("case", ["no documents", "no labels", "other columns"])
def test_run_of_odd_tables(spark, corpus, tmp_path, case):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    if case == "no documents":
        docs = docs.limit(0)
    elif case == "no labels":
        labels = labels.limit(0)
    else:  # names that stages use themselves, and nulls in every column
        docs = docs.selectExpr("*", "'x' AS h", "7 AS size", "doc_id AS id", "text AS sha", "1 AS copies", "'y' AS __gone").limit(60)
        docs = docs.union(docs.limit(2).selectExpr(*[f"CAST(NULL AS {kind}) AS {c}" for c, kind in docs.dtypes])).union(docs.limit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) == 0) == (case == "no documents")
    if case == "no labels":  # nothing is toxic then
        assert len(got) > 200
