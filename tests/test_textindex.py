import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from tidelog.operators import fulltext
from tidelog.sources.textindex import TextIndex

SCHEMA = "doc_id bigint, text string, kind string"
TEXTS = ("segment compaction storage engine", "database index replication backup", "search query ranking results", "segment segment index", "", None)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path, seed):
    rnd, model = random.Random(seed), {}
    path = str(tmp_path / "i")
    index = TextIndex(spark, path, facets=("kind",))
    for _ in range(7):
        step = rnd.choice(["index", "index", "index", "delete", "merge", "reopen"])
        if step == "index":
            rows = [(i, rnd.choice(TEXTS), rnd.choice("ab")) for i in rnd.sample(range(8), 3)]
            model.update({i: (t, k) for i, t, k in rows})
            index.index_documents(spark.createDataFrame(rows, SCHEMA))
        elif step == "delete" and model:
            gone = [rnd.choice(sorted(model)), 99]
            model.pop(gone[0])
            index.delete_documents(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
        elif step == "merge":
            index.merge()
        else:
            index = TextIndex(spark, path, facets=("kind",))
    live = spark.createDataFrame([(i, t, k) for i, (t, k) in model.items()], SCHEMA)
    assert tuples(index.documents(), "doc_id", "kind") == sorted(((i, k) for i, (_, k) in model.items()), key=repr)
    n, avg = fulltext.documents_stats(live)
    assert index.stats() == (n, pytest.approx(avg))
    for query, options in (("segment index segment", {}), ("segmnt", {"typo": True}), ("segment", {"facets": {"kind": "a"}}), ("", {})):
        assert tuples(index.search(query, 5, **options)) == tuples(fulltext.search(live, query, 5, **options))
    assert index.contains(99) is False
    asked = spark.createDataFrame([(1, "segment index segment"), (2, "results"), (3, None)], "query_id bigint, query string")
    for q, text in ((1, "segment index segment"), (2, "results")):
        assert tuples(index.search_many(asked, 3).where(f"query_id = {q}"), "doc_id", "score") == tuples(fulltext.search(live, text, 3))


def test_a_stemmed_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), "en")
    assert index.search("anything", 3).count() == 0 and index.merge() is None and index.stats() == (0, 0.0)
    docs = spark.createDataFrame([(1, "Compacting the segments", "x"), (2, "the compaction of a segment", "x")], SCHEMA)
    index.rebuild(docs)
    assert tuples(index.search("compacted segment", 5)) == tuples(fulltext.search(docs, "compacted segment", 5, lang="en"))
    assert index.scores("segment", only=2).count() == 1
    index.rebuild(docs.where("doc_id = 1"))
    assert tuples(index.documents(), "doc_id") == [(1,)]


def test_one_tokenizer(spark):
    texts = ["naïve CAFÉ_bar x2", "İstanbul ﬁle", "का हिन्दी", "a·b ٣٤", "Ⅷ ²", "été", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: [t for t, _ in fulltext.runs(x)] for i, x in enumerate(texts)}
    got = {r[0]: r[1] for r in df.select("doc_id", fulltext.token_array(F.col("text"))).collect()}
    assert got == want
