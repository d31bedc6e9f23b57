import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from tidelog.functions import codecs
from tidelog.functions import vectors as fv
from tidelog.functions.stem import english, portuguese
from tidelog.operators import fulltext, vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 16)).astype(np.float32)
    data[7] = 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)] + [(900, [1.0, 2.0], "x"), (901, None, "x")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, distance string"), data.astype(float)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_top_k_and_batch_agree_with_numpy(points, metric):
    df, data = points
    q = data[3]
    want = np.round(fv.distances(q[None], data, metric)[0], 6) + 0.0
    order = np.lexsort((np.arange(300), want))[:10]
    assert [tuple(r) for r in vectors.top_k(df, q.tolist(), 10, metric).collect()] == [(int(i), pytest.approx(want[i], abs=2e-6)) for i in order]
    batch = vectors.batch_knn(df, df.where("vec_id = 3"), 10, metric).orderBy("rank").collect()
    assert [r["vec_id"] for r in batch] == order.tolist()
    assert vectors.top_k(df, q.tolist(), 0, metric).count() == 0
    assert vectors.batch_knn(df, df.limit(0), 3, metric).count() == 0


def test_zero_norm_and_aliases(points):
    df, _ = points
    assert vectors.top_k(df, [0.0] * 16, 3, "cosine").collect()[0]["distance"] == 0.0
    assert fv.METRICS["euclidean"] == "l2" and fv.METRICS["dotproduct"] == "dot"


def test_cell_index(spark, points, tmp_path):
    df, data = points
    index = vectors.CellIndex(spark, str(tmp_path)).build(df.where("vec_id < 900"), 10, stamp="one")
    hits = 0
    for i in (1, 50, 200):
        want = set(np.argsort(((data - data[i]) ** 2).sum(1))[:10].tolist())
        hits += len(want & {r[0] for r in index.search(data[i].tolist(), 10, probes=7).collect()})
    assert hits >= 27
    assert spark.read.parquet(f"{tmp_path}/cells").count() == 300
    assert index.stale("two") and not index.stale("one")


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_cell_index_recall_over_a_whole_table(spark, tmp_path, metric):
    data = np.random.default_rng(5).normal(size=(3_000, 32))
    df = spark.createDataFrame(list(enumerate(data.tolist())), "vec_id bigint, embedding array<double>")
    index = vectors.CellIndex(spark, str(tmp_path)).build(df, 60, metric)
    head = index.head()
    far = fv.distances(np.random.default_rng(6).normal(size=(6, 32)), data, metric)
    hits = 0
    for q, d in zip(np.random.default_rng(6).normal(size=(6, 32)), far):
        hits += len(set(d.argsort()[:10].tolist()) & {r[0] for r in index.search(q.tolist(), 10).collect()})
    assert hits >= 54
    assert [k for k, _ in head["probes"]] == [1, 10, 100] and all(1 <= n <= 60 for _, n in head["probes"])
    assert index.search(data[0].tolist(), 3_000).count() == 3_000  # beyond what was measured: all cells


def test_codecs_round_trip():
    for dtype, values in (("F32", [1.5, -2.0]), ("F16", [0.5, 65504.0]), ("I8", [-128, 127])):
        dims, kind, got = codecs.decode_vector(codecs.encode_vector(values, dtype))
        assert (dims, kind, got.tolist()) == (2, dtype, values)
    assert codecs.decode_vector(b"\x00\x02\x00abc") is None and codecs.decode_vector(None) is None
    with pytest.raises(ValueError):
        codecs.check_vector(3, "F32", b"1234")
    facets = {"category": "news", "n": 42, "ok": True}
    assert codecs.decode_text(codecs.encode_text("olá", facets)) == ("olá", facets)
    assert codecs.decode_text(b"\x05\x00\x00\x00ab") is None and codecs.decode_text(None) is None


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, category string, n bigint")


def test_ranking_facets_typos(spark):
    df = docs(spark, [(1, "segment segment compaction", "news", 1), (2, "segment compaction", "sports", 1), (3, None, "news", 1), (4, "", "news", 1)])
    assert [r["doc_id"] for r in fulltext.search(df, "segment", 5).collect()] == [1, 2]
    assert [r["doc_id"] for r in fulltext.search(df, "segment", 5, facets={"category": "sports"}).collect()] == [2]
    assert fulltext.search(df, "segment", 5, facets={"n": "1"}).count() == 0
    assert fulltext.search(df, "segment", 5, facets={"none": 1}).count() == 0
    assert fulltext.search(df, "segmnt", 5).count() == 0
    assert fulltext.search(df, "segmnt", 5, typo=True).count() == 2
    assert fulltext.search(df, "", 5).count() == fulltext.search(df, "the a an", 5, lang="en").count() == 0
    one, two = fulltext.search(df, "segment", 5).collect()[0]["score"], fulltext.search(df, "segment segment", 5).collect()[0]["score"]
    assert two == pytest.approx(2 * one, abs=2e-6)
    assert tuples(fulltext.corpus_stats(df)) == [(4, 5, 1.25)]
    assert fulltext.search(df.limit(0), "segment", 5).count() == 0


def test_positions_snippets_stems(spark):
    df = docs(spark, [(1, "alpha beta gamma", "", 1), (2, "os gatos correm rápido!", "", 1)])
    assert tuples(fulltext.token_positions(df.where("doc_id = 1")), "term", "pos") == [("alpha", 0), ("beta", 6), ("gamma", 11)]
    assert [r["doc_id"] for r in fulltext.search(df, "gatos", 5, lang="pt").collect()] == [2]
    snippet = fulltext.snippets(df, "rápido", 3).first()
    assert (snippet["snippet"], snippet["match_start"], snippet["match_end"]) == ("em rápido!", 3, 11)
    assert [english(w) for w in "running flies happily relational hopping generously skies cry by".split()] == "run fli happili relat hop generous sky cri by".split()
    assert [portuguese(w) for w in "gatos correndo rapidamente nações".split()] == ["gat", "corr", "rapid", "naçõ"]


def test_positions_of_every_language(spark, tmp_path):
    from tidelog.plans import catalog

    rows = [(1, "the running cats", "en"), (2, "the running cats", " EN"), (3, "the running cats", "en-US"), (4, "os gatos correndo", "pt-BR"), (5, "os gatos correndo", "PT")]
    rows += [(6, "the running gatos", None), (7, "the running gatos", "es"), (8, "running", "eng"), (9, None, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["postings_positions"](spark, str(tmp_path))
    want = [(i, t, p) for i in (1, 2, 3) for t, p in (("run", [4]), ("cat", [12]))] + [(i, t, p) for i in (4, 5) for t, p in (("gat", [3]), ("corr", [9]))]
    want += [(i, t, p) for i in (6, 7) for t, p in (("the", [0]), ("running", [4]), ("gatos", [12]))] + [(8, "running", [0])]
    assert tuples(got, "doc_id", "term", "positions") == sorted(want, key=repr)


def test_typo_edits_are_characters(spark):
    index = spark.createDataFrame([("hallo",), ("helllo",), ("hell",), ("heloh",), ("hello",), ("héllo",)], "term string")
    assert tuples(fulltext.typo_candidates(index, ["hello"]), "term") == sorted([("hallo",), ("helllo",), ("hell",), ("héllo",)], key=repr)


def test_quantization(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0],), ([2.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(fv.scalar_quantized(F.col("v"))).collect()] == [[-128, 0, 127], [-128, -128]]


def test_graph_index(spark, tmp_path, monkeypatch):
    from tidelog.operators import graph

    monkeypatch.setattr(graph, "SHARD_ROWS", 200)
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(12, 8))[rng.integers(0, 12, 500)] + 0.3 * rng.normal(size=(500, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = graph.GraphIndex(spark, str(tmp_path / "g")).build(df.where("vec_id < 450 or vec_id >= 900"), stamp="one")
    assert index.search(data[3].tolist(), 1).collect()[0]["vec_id"] == 3
    index.insert(df.where("vec_id between 450 and 499"), stamp="two")
    assert index.stale("one") and not index.stale("two")
    got = index.search_many(df.where("vec_id % 50 = 0"), 10).collect()
    hits = 0
    for q in range(0, 500, 50):
        want = set(np.argsort(((data - data[q]) ** 2).sum(1), kind="stable")[:10].tolist())
        hits += len(want & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 95
    q = data[7].tolist()
    assert vectors.search(df, q, 5, "l2", index, "two").collect()[0]["vec_id"] == 7
    assert [tuple(r) for r in vectors.search(df, q, 5, "l2", index, "one").collect()] == [tuple(r) for r in vectors.top_k(df, q, 5, "l2").collect()]
    copy = graph.Graph.from_bytes(graph.Graph("cosine").insert(range(50), data[:50]).to_bytes())
    assert copy.search(data[9], 1)[0][1] == 9 and graph.Graph().search([1.0], 3) == []


def test_stored_vectors_of_all_types(spark):
    rows = [(1, "n", 2, t, np.array(v, codecs.DTYPES[t]).tobytes(), 5) for t, v in (("F32", [1, 2]),)]
    rows += [(2, "n", 2, "F16", np.array([1, 3], "<f2").tobytes(), 1), (3, "n", 2, "I8", bytes([255, 2]), 1), (1, "n", 2, "F32", np.array([9, 9], "<f4").tobytes(), 4)]
    rows += [(4, "n", 2, "F32", b"123", 1), (5, "n", 2, "F32", np.array([np.nan, 1], "<f4").tobytes(), 1), (6, "n", 2, "X", b"12", 1), (7, "n", None, "I8", b"12", 1), (2, "n", 2, "F16", b"", 9)]
    df = spark.createDataFrame(rows, "vector_id bigint, ns string, dims int, dtype string, vector_data binary, lsn bigint")
    assert tuples(vectors.usable_nodes(df), "vector_id", "embedding") == [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [-1.0, 2.0])]


def test_one_edit_is_levenshtein_of_one(spark):
    import itertools

    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)] + ["é", "cafe", "café"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert [fulltext.one_edit(r["a"], r["b"]) for r in df.select("a", "b", F.levenshtein("a", "b").alias("d")).collect()] == [r["d"] == 1 for r in df.select(F.levenshtein("a", "b").alias("d")).collect()]
