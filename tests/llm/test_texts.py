"""Contamination, mixing, reading level."""

import random
import re

import numpy as np
import pytest

from tests.conftest import tuples
from tidelog.llm import contamination as C
from tidelog.llm import mixing as M
from tidelog.llm import reading as R


@pytest.mark.parametrize(
    "a, b",
    [
        ("Naïve <b>Th</b>e CAFÉ_bar", "naive the cafe bar"),
        ("re-\nported up-\r\n  load", "reported upload"),
        ("soft\xad\nly", "softly"),
        ("ze​ro so­ft ４２ ﬁle", "zero soft 42 file"),
        ("**bold** [link](http://x.y/z) `code`!", "bold link code"),
        ("ñ café straße", "n cafe strasse"),
        ("a<br/>b 3 < 4 > 2", "ab 3 4 2"),
    ],
)
def test_words(a, b):
    assert C.words(a) == b.split()


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rnd = random.Random(6)
    for _ in range(300):
        p, t = [rnd.randrange(4) for _ in range(rnd.randint(1, 90))], [rnd.randrange(4) for _ in range(rnd.randint(0, 60))]
        assert C.myers_distance(p, t) == edit(p, t)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, "s", " ".join(word() for _ in range(rnd.choice([3, 8, 30, 60])))) for i in range(30)]
    texts = []
    for d in range(150):
        body = [word() for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.5:
            item = rnd.choice(items)[2].split()
            a = rnd.randrange(len(item))
            piece = item[a : a + rnd.choice([5, 9, 10, 11, 40])]
            if rnd.random() < 0.4:
                piece = item[:]
                for _ in range(rnd.randint(0, 6)):
                    piece[rnd.randrange(len(piece))] = word()
            at = rnd.randint(0, len(body))
            body[at:at] = piece
        texts.append((d, " ".join(body), "x"))
    texts += [(900, None, "x"), (901, "", "x"), (902, "long " * 200_000 + items[5][2], "x"), (903, texts[0][1], "x")]
    return spark.createDataFrame(texts, "doc_id bigint, text string, item_id string").repartition(3), spark.createDataFrame([*items, (77, "s", None), (78, "s", "")], "item_id bigint, suite string, text string"), texts, items


def test_contaminated_against_brute_force(corpus):
    docs, items, texts, raw = corpus
    want = set()
    for d, text, _ in texts:
        w = (text or "").split()
        grams = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
        for i, _, item in raw:
            x = item.split()
            if any(tuple(x[j : j + 10]) in grams for j in range(len(x) - 9)):
                want.add((d, i))
    assert tuples(C.contaminated(docs, items)) == sorted(want, key=repr)


def test_whole_items_within_budget_are_all_found(corpus, monkeypatch):
    docs, items, texts, raw = corpus
    monkeypatch.setattr(C, "BLOCK_CHARS", 1_000)
    got = {(r["doc_id"], r["item_id"]): r for r in C.leaked_items(docs, items).collect()}
    for d, text, _ in texts:
        if d == 902:
            continue
        w = (text or "").split()
        for i, _, item in raw:
            x = item.split()
            distance, budget = edit(x, w), max(1, len(x) // C.PIECE) - 1
            if distance <= budget:
                assert got[d, i]["whole"] and got[d, i]["distance"] == distance
            elif (d, i) in got:
                assert got[d, i]["longest_run"] >= 10 and not got[d, i]["whole"]


def test_contamination_of_nothing(corpus):
    docs, items, _, _ = corpus
    assert C.leaked_items(docs.limit(0), items).count() == 0
    assert C.leaked_items(docs, items.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 500):
        p, w = rng.random(n), rng.integers(1, 40, n)
        q = M.fly(p, w, rng)
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        assert (q * w).sum() == pytest.approx((p * w).sum()) and q.sum() == pytest.approx(p.sum())
    equal = M.fly(np.full(100, 0.3), np.full(100, 5), rng)
    assert equal.sum() == pytest.approx(30)
    mean = np.mean([M.fly(np.full(9, 0.3), np.arange(1, 10), np.random.default_rng(s)) for s in range(2000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_mix_reaches_shares(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["log", "key", "segment"]) for _ in range(rnd.randint(1, 60))), rnd.choice(["Big_One", "big-one ", "BIG-ONE"]), 0) for i in range(900)]
    rows += [(1000 + i, "a b c " * rnd.randint(1, 9), "tiny", 0) for i in range(30)] + [(2000, None, "tiny", 0), (2001, "", "tiny", 0), (2002, "x", None, 0), (2003, "x", "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("big-one", 0.6, 1), ("tiny", 0.2, 3), ("absent", 0.2, 9)], "source_name string, target_share double, max_repeats int")
    for block in (50_000, 40):
        chosen, _, counted = M.draw(docs, targets, block=block)
        out = {r["source_name"]: r for r in chosen.groupBy("source_name").agg({"tokens": "count", "copies": "max"}).collect()}
        assert set(out) == {"big-one", "tiny"} and out["big-one"]["max(copies)"] == 1 and out["tiny"]["max(copies)"] == 3
        assert chosen.count() == chosen.select("doc_id").distinct().count()
        used = {s: sum(r["tokens"] * r["copies"] for r in chosen.where(f"source_name = '{s}'").collect()) for s in out}
        assert used["big-one"] / sum(used.values()) == pytest.approx(0.75, abs=0.01)
    report = {r["source_name"]: r for r in M.mix_report(docs, targets).collect()}
    assert not report["absent"]["reachable"] and report["absent"]["reached_share"] == 0
    assert report["big-one"]["reached_share"] == pytest.approx(report["big-one"]["effective_share"], abs=0.01)
    small = {r["source_name"]: r for r in M.mix_report(docs, targets, total_tokens=1_000).collect()}
    assert sum(r["tokens"] for r in small.values()) == pytest.approx(1_000, abs=60)
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0


def grade(text):
    lines, out, fenced = re.sub("\r\n?", "\n", text).split("\n"), [], False
    for line in lines:
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced:
            out.append(line)
    parts = [""]
    for line in out:
        if not line.strip(" \t") or re.match(r"#|- |\* |\d+[.)] ", line):
            parts.append("")
        parts[-1] += line + "\n"
    sentences = [s for p in parts for s in re.split(r"[.!?](?=\s|$)", p) if re.search(r"[^\W\d_]", s)]
    words = [w for p in parts for w in re.findall(r"[^\W\d_]+", p)]
    if not words:
        return 0, None
    return len(words), 4.71 * sum(map(len, words)) / len(words) + 0.5 * len(words) / len(sentences) - 21.43


def test_levels(spark):
    rnd = random.Random(5)
    easy, hard = [f"{a}{b}" for a in "abcd" for b in "xyz"], [f"{a}zation{b}mentality" for a in ("uni", "multi", "inter", "hetero") for b in ("a", "b", "c")]
    texts = []
    for i in range(120):
        pool = hard if i % 2 else easy
        n = rnd.randint(3, 30) if i % 5 == 0 else rnd.randint(45, 120)
        text = "".join(rnd.choice(pool) + (rnd.choice([". ", "! ", "\n- ", "\n\n", "\r\n3) ", "...x ", "? "]) if rnd.random() < (0.05 if i % 2 else 0.3) else " ") for _ in range(n))
        if i % 7 == 0:
            text = "# head\n```\ncode block. " + "word " * 50 + "\n```\n" + text + "\n```x\nopen fence"
        texts.append((i, text))
    texts += [(500, None), (501, ""), (502, "12 34."), (503, "word " * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'c' as grade", "'c' as words")
    got = {r["doc_id"]: r for r in R.reading_levels(docs).collect()}
    assert len(got) == len(texts)
    want = {i: grade(t or "") for i, t in texts}
    for i, (n, g) in want.items():
        assert got[i]["words"] == n and got[i]["grade"] == (None if g is None else pytest.approx(g))
        assert got[i]["basis"] == ("formula" if n >= 40 else "graph" if n else "none") and got[i]["difficulty"] is not None
    assert tuples(R.demanding_documents(docs)) == sorted([(i,) for i, (n, g) in want.items() if n >= 40 and g >= 16], key=repr)
    short = [r for i, r in got.items() if r["basis"] == "graph"]
    assert min(r["difficulty"] for r in short if r["doc_id"] % 2) > max(r["difficulty"] for r in short if not r["doc_id"] % 2)
    held = R.reading_levels(docs, held_out=0.4).where("basis = 'graph' and words >= 40 and doc_id < 500").toPandas()
    assert np.corrcoef(held["grade"], held["difficulty"])[0, 1] > 0.8
    assert R.reading_levels(docs.limit(0)).count() == 0
    assert R.reading_levels(docs.where("doc_id >= 500 and doc_id < 503")).where("difficulty is null").count() == 3


def test_propagation_runs_only_where_it_decides(spark, monkeypatch):
    hard, easy = "institutionalization internationalization " * 30, "a cat sat. " * 30
    rows = [(1, hard), (1, hard), (None, hard), (2, easy), (3, "institutionalization"), (4, "cat"), (5, None), (6, ""), (7, "12 34."), (8, "```\n" + hard)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    levels = R.reading_levels(docs)
    got = {r["doc_id"]: r for r in levels.collect()}
    assert got[3]["difficulty"] > 16 > got[4]["difficulty"] and {got[3]["basis"], got[4]["basis"]} == {"graph"}
    bands = {(r["band"], r["basis"]): r["documents"] for r in R.level_profile(docs).collect()}
    assert all(bands[got[i]["difficulty"] // 4 * 4, "graph"] == 1 for i in (3, 4))
    clamped = tuples(levels.where("basis = 'formula' and difficulty >= 16"), "doc_id")
    assert clamped == [(1,), (1,), (None,)]
    labels = []
    for name in ("materialise", "scratch"):
        real = getattr(R, name)
        monkeypatch.setattr(R, name, lambda x, label, real=real: (labels.append(label), real(x, label))[1])
    assert tuples(R.demanding_documents(docs)) == clamped
    assert not {"edges", "words", "levels"} & set(labels)
    assert tuples(R.demanding_documents(docs, least_words=1)) == [(1,), (1,), (3,), (None,)]
    assert R.demanding_documents(docs.limit(0)).count() == 0
