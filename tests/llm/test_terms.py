import math
import random
from collections import Counter, defaultdict

import pytest

from tests.conftest import tuples
from tidelog.llm import terms

POSTINGS = "ns string, term string, doc_id bigint, term_freq int, doc_len_tokens int, indexed_lsn bigint, category string, positions array<int>, weight string"
SIZES = "ns string, lang string, total_docs bigint, total_doc_len bigint, sidecar_lsn bigint"


@pytest.fixture(scope="module")
def collection(spark):
    rnd = random.Random(9)
    texts, rows = {}, []
    for ns, size in (("big", 60), ("small", 7)):
        for doc in range(size):
            words = [rnd.choice("the of log key".split()) if rnd.random() < 0.5 else f"w{rnd.randrange(60)}" for _ in range(rnd.randint(3, 40))]
            texts[ns, doc] = words
            where = defaultdict(list)
            for i, w in enumerate(words):
                where[w].append(7 * i)
            for w, places in where.items():
                rows.append((ns, w.upper() if rnd.random() < 0.1 else f" {w} ", doc, None if rnd.random() < 0.2 else len(places), len(words), 50, "c", places, "clash"))
            rows.append((ns, "old", doc, 5, 5, 10, "c", [1, 2, 3, 4, 5], "clash"))
    rows += rnd.sample(rows, 100)
    rows += [(None, "x", 1, 1, 1, 1, None, [0], ""), ("big", None, 1, 1, 1, 50, None, [0], "")]
    rnd.shuffle(rows)
    sizes = [("big", "en", 60, 1, 9), ("big", "en", 3, 1, 1), ("small", "en", 7, 1, 5), ("small", "en", None, 1, None)]
    return spark.createDataFrame(rows, POSTINGS), spark.createDataFrame(sizes, SIZES), texts


def test_weights_and_distinctive_terms(collection):
    postings, sizes, texts = collection
    tf = {(ns, d): Counter(w) for (ns, d), w in texts.items()}
    n = {"big": 60, "small": 7}
    gf, df, spread = Counter(), Counter(), defaultdict(list)
    for (ns, d), c in tf.items():
        for w, k in c.items():
            gf[ns, w] += k
            df[ns, w] += 1
            spread[ns, w].append(k)
    got = {(r["ns"], r["doc_id"], r["term"]): r for r in terms.log_entropy(postings, sizes).collect()}
    assert len(got) == sum(map(len, tf.values()))
    for (ns, d), c in tf.items():
        for w, k in c.items():
            h = -sum(x / gf[ns, w] * math.log(x / gf[ns, w]) for x in spread[ns, w])
            row = got[ns, d, w]
            assert row["tf"] == k and row["df"] == df[ns, w]
            assert row["weight"] == pytest.approx(math.log(1 + k) * max(0, 1 - h / math.log(n[ns])), abs=1e-9)
    for least in (0.05, 0.3, 0.6):
        want = [(ns, d, w) for (ns, d), c in tf.items() for w, k in c.items() if k / len(texts[ns, d]) * math.log(n[ns] / df[ns, w]) >= least]
        assert tuples(terms.distinctive_terms(postings, sizes, least)) == sorted(want, key=repr)


def test_ngrams_and_marks(collection):
    postings, sizes, texts = collection
    tf, docs = Counter(), defaultdict(set)
    for (ns, d), words in texts.items():
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                g = (ns, n, " ".join(words[i : i + n]))
                tf[g] += 1
                docs[g].add(d)
    want = sorted(((*g, k, len(docs[g])) for g, k in tf.items()), key=repr)
    assert tuples(terms.ngram_frequencies(postings, 3)) == want
    assert tuples(terms.ngram_frequencies(postings, 1)) == [w for w in want if w[1] == 1]
    total = {"big": 60, "small": 7}
    bad = [(ns, g) for (ns, n, g), k in tf.items() if n == 1 and (k < 3 or len(docs[ns, n, g]) * 10 > total[ns] * 3)]
    assert tuples(terms.useless_terms(postings, sizes)) == sorted(bad, key=repr)


@pytest.mark.parametrize("chunk", [2, 8])
def test_repeated_ngrams_have_no_cut(spark, chunk):
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(23)]
    texts = {("n", d): [rnd.choice("abc") for _ in range(rnd.randint(1, 9))] for d in range(12)}
    texts["n", 20], texts["n", 21], texts["n", 22] = ["x", *passage, "a"], [*passage, "y", *passage[:9]], ["a"] * 30
    texts["m", 1] = passage
    rows = []
    for (ns, d), words in texts.items():
        where = defaultdict(list)
        for i, w in enumerate(words):
            where[w].append(3 * i)
        rows += [(ns, w, d, len(at), len(words), 1, None, at, "") for w, at in where.items()]
    tf, docs = Counter(), defaultdict(set)
    for (ns, d), words in texts.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                g = (ns, tuple(words[i:j]))
                tf[g] += 1
                docs[g].add(d)
    longer = {(ns, g[:-1]) for (ns, g), k in tf.items() if len(g) > 1 and tf[ns, g[:-1]] == k}
    want = sorted(((ns, len(g), "".join(f"{w} " for w in g), k, len(docs[ns, g])) for (ns, g), k in tf.items() if k > 1 and (ns, g) not in longer), key=repr)
    got = terms.repeated_ngrams(spark.createDataFrame(rows, POSTINGS), chunk)
    assert sorted(((r["ns"], r["n"], "".join(f"{w} " for w in r["gram"]), r["total_tf"], r["df"]) for r in got.collect()), key=repr) == want
    assert terms.repeated_ngrams(spark.createDataFrame([], POSTINGS)).count() == 0


def test_empty_and_unknown(collection, spark):
    postings, sizes, _ = collection
    assert terms.distinctive_terms(postings.limit(0), sizes).count() == 0
    assert terms.useless_terms(postings.limit(0), sizes).count() == 0
    assert terms.distinctive_terms(postings, sizes.limit(0)).count() == 0
    assert terms.log_entropy(postings, sizes.limit(0)).where("weight is not null").count() == 0
    one = spark.createDataFrame([("n", "t", 1, 0, None, None, None, None, "")], POSTINGS)
    assert terms.log_entropy(one, spark.createDataFrame([("n", "en", 1, 1, 1)], SIZES)).first()["weight"] == 0.0
    assert tuples(terms.ngram_frequencies(one)) == [("n", 1, "t", 0, 1)]
