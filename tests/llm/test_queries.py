"""The registered text queries over given tables: SQL where there is some, plain versions, folds and the pipeline elsewhere."""

import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glasstide.llm import bpe, quality, toxicity
from glasstide.llm.queries import ORACLE_SQL, QUERIES, word_vocabulary
from tests.oracle import same

from . import brute
from .test_operators import plain_contamination

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name,modulus", [("op1_quality_classifier", 3), ("op2_lm_scoring", 5), ("op5_toxicity", 3)])
def test_folds_and_rows(spark, docs, name, modulus):
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(i for i, _ in docs)
    assert all(h == (zlib.crc32(str(i).encode()) % modulus == 1) for i, h in zip(got["doc_id"], got["held_out"]))


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    got = QUERIES["op1_quality_classifier"](spark, SF).toPandas()
    held = got[got["held_out"] & got["doc_id"].isin(labels.index)]
    assert (held["predicted"].to_numpy() == labels.loc[held["doc_id"], "quality"].to_numpy()).mean() >= 0.9


def test_quality_scores_are_a_plain_walk_over_plain_statistics(spark, docs):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = quality.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    extra = [(-1, None), (-2, ""), (-3, "\n \t"), (-4, "é" * 3000 + " ÀB\x0b!! A")]
    odd = spark.createDataFrame(extra, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(raw.unionByName(odd), trees).collect()}
    for i, text in docs + extra:
        x, margin = brute.statistics(text), trees.base
        for t in range(len(trees.value)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + int(x[trees.feature[t, node]] > trees.threshold[t, node] + 1e-12)
            margin += trees.value[t, node - 2**trees.depth + 1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6), i


def test_model_beats_base(spark):
    got = QUERIES["op2_lm_scoring"](spark, SF).toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_similar(spark, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op3_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute.similar(docs)


def test_secrets(spark, docs):
    spans = brute.secret_spans(docs)
    for r in QUERIES["op9_secret_scans"](spark, SF).collect():
        base = brute.base_secrets(dict(docs)[r.doc_id])
        written = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == name for _, _, k, _ in base) for name in ("assign", "access", "hex"))
        assert r.base_sha256 == brute.sha(",".join(written)) and r.spans == spans[r.doc_id]


def test_pipeline(spark, docs):
    """run() against the same decisions taken one after the other in plain Python; the toxicity model is the operator's own."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(raw.select("doc_id", "text"), model).where("predicted = 1").collect()}
    left = [(i, t) for i, t in docs if i not in toxic]
    classes = brute.similar(left)
    left = [(i, t) for i, t in left if classes[i][0] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in plain_contamination(left, items) if hit and 20 * hit >= n}
    left = [(i, t) for i, t in left if str(i) not in bad]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in left}
    encoder = bpe.Encoder(bpe.load_vocabulary(word_vocabulary()))
    for i, text in left:
        if not brute.base_secrets(text):
            assert got[i].ids == encoder.encode(text or "")[1]
        else:
            out, at = "", 0
            for a, _, _, b in brute.base_secrets(text):
                if a >= at:
                    out += text[at:a] + "[secret]"
                at = max(at, b)
            assert got[i].ids == encoder.encode(out + text[at:])[1]


def test_stages_keep_the_columns_and_their_values(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.col("doc_id") + k for k, c in enumerate(("Score", "predicted", "N_WORDS", "n_hit", "items", "base", "spans", "kept"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, raw, SF)
        assert out.columns == raw.columns and out.count() > 0
        assert out.where(F.array_max(F.array(*[F.col(c) - F.col("doc_id") != k for k, c in enumerate(raw.columns[-8:])]))).count() == 0
        assert stage(spark, raw.limit(0), SF).count() == 0


def test_similar_rows_go_by_row(spark):
    """Texts that share an id are judged each by itself; rows without id or words, exact repeats and other columns have their say."""
    a, b, c = (" ".join(f"w{i}x{k}" for i in range(60)) for k in range(3))
    near = b.replace("w30x1", "other")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (2, b, 3), (None, near, 4), (None, c, 5), (None, c, 5), (7, None, 6), (8, "", 7), (None, " ", 8), (3, b, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = corpus_pipeline.keep_one_of_similar(spark, docs, SF).collect()
    assert sorted(r.n for r in got) == [1, 3, 5, 6, 7, 8]


def test_pipeline_with_awkward_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, "", "en", None, 0), (None, text + " more", "en", "s", 7), (3, "x " * 50_000, "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [i for i, _ in got] == ["1", "2", "3", "None"] and dict(got)["2"] == dict(got)["None"] == 0 and dict(got)["3"] == 50_000
