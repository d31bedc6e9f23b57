import numpy as np
import pytest

from tests.conftest import tuples
from tidelog.llm import neighbours as N

SCHEMA = "vector_id bigint, ns string, dims int, dtype string, vector_data binary, lsn bigint, unit string"


def rows(data, ns, dtype, first=0, lsn=5):
    kind = N.ELEMENTS[dtype]
    return [(first + i, ns, data.shape[1], dtype, v.astype(kind).tobytes(), lsn, "clash") for i, v in enumerate(data)]


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(120, 24))
    a = np.repeat(centres, 5, 0) + 0.08 * rng.normal(size=(600, 24))
    b = np.clip(np.round(40 * rng.normal(size=(50, 12))), -127, 127)
    out = rows(a, "a", "F32") + rows(a[:100] * 3, "h", "F16", 2000) + rows(b, "b", "I8", 3000)
    out += rows(-a[:40], "a", "F32", 0, 1)  # earlier versions
    out += [(9000, "a", 24, "F32", b"short", 9, ""), (9001, "a", 24, "F32", np.full(24, np.nan, "<f4").tobytes(), 9, ""), (9002, "a", 24, "F32", bytes(96), 9, "")]
    out += [(3, "a", 24, "F32", bytes(96), 99, ""), (None, "a", 24, "F32", bytes(96), 1, ""), (9003, "a", 24, None, bytes(96), 1, ""), (9004, "a", None, "F32", bytes(96), 1, "")]
    out += out[:30]
    return spark.createDataFrame(out, SCHEMA)


def brute(nodes, k):
    v = N.usable_vectors(nodes).toPandas()
    top = {}
    for (_, dims), g in v.groupby(["ns", "dims"]):
        g = g.sort_values("vector_id")
        ids, x = g["vector_id"].to_numpy(), np.frombuffer(b"".join(g["unit"]), np.float32).reshape(len(g), dims).astype(float)
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for i, o in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]):
            top[ids[i]] = [(int(ids[j]), s[i, j]) for j in o if s[i, j] > -9]
    return top


def test_usable(nodes):
    got = N.usable_vectors(nodes)
    assert got.count() == 750 and got.where("vector_id >= 9000").count() == 0


@pytest.mark.parametrize("block_rows", [16_384, 128])
def test_recall(nodes, block_rows):
    top = brute(nodes, 10)
    got = tuples(N.most_similar(nodes, 10, block_rows=block_rows), "vector_id", "neighbour")
    right = {(i, j) for i, near in top.items() for j, _ in near}
    assert len(set(got) & right) >= 0.97 * len(right)
    close = {(min(i, j), max(i, j)) for i, near in top.items() for j, s in near if s >= 0.9}
    near = N.most_similar(nodes, 10, 0.9, block_rows).where("similarity >= 0.9").select("vector_id", "neighbour")
    found = {(min(i, j), max(i, j)) for i, j in tuples(near)}
    assert found <= close and len(found) >= 0.97 * len(close)


def test_copies_and_ties(spark):
    v = np.eye(4)
    data = spark.createDataFrame(rows(np.repeat(v[:1], 30, 0), "a", "F32") + rows(v[1:2] + 0.2 * v[:1], "a", "F32", 100), SCHEMA)
    got = tuples(N.most_similar(data, 3, block_rows=8), "vector_id", "neighbour")
    assert [n for i, n in got if i == 0] == [1, 2, 3] and [n for i, n in got if i == 2] == [0, 1, 3] and [n for i, n in got if i == 29] == [0, 1, 2]
    assert [n for i, n in got if i == 100] == [0, 1, 2]
    assert len(got) == 31 * 3


def test_a_hot_vector_is_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 7)
    data = spark.createDataFrame(rows(np.repeat(np.eye(4)[:1], 60, 0), "a", "F32") + rows(np.eye(4)[1:3] + 0.1, "a", "F32", 100), SCHEMA)
    got = tuples(N.most_similar(data, 2), "vector_id", "neighbour")
    assert got == sorted([(i, j) for i in range(60) for j in [x for x in range(3) if x != i][:2]] + [(i, j) for i in (100, 101) for j in ((101, 0) if i == 100 else (100, 0))], key=repr)


def test_descent_reaches_what_a_scan_of_all_regions_does():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(4_000, N.PROJECTED)).astype(np.float32)
    tree = N.Tree.fit(sample, 6)
    own = tree.place(sample)
    assert np.bincount(own, minlength=64).min() > 50
    low, high = np.full((64, N.PROJECTED), -np.inf), np.full((64, N.PROJECTED), np.inf)
    for region in range(64):
        node = region + 64
        while node > 1:
            up, axis = node // 2, tree.axes[node // 2]
            if node % 2:
                low[region, axis] = max(low[region, axis], tree.cuts[up])
            else:
                high[region, axis] = min(high[region, axis], tree.cuts[up])
            node = up
    rows_, radius, most = sample[:200], rng.uniform(0, 3, 200), rng.uniform(0, 2, 64)
    gaps = (np.maximum(np.maximum(low - rows_[:, None], rows_[:, None] - high), 0) ** 2).sum(2)
    far = np.maximum(radius[:, None], most[None, :])
    got = set(zip(*map(np.ndarray.tolist, tree.reach(rows_, radius, most))))
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(gaps <= far - 1e-4))} <= got <= {(int(i), int(j)) for i, j in zip(*np.nonzero(gaps <= far + 1e-4))}


def test_empty(nodes):
    assert N.similar_pairs(nodes.limit(0)).count() == 0


def test_chi_square_quantiles():
    for p, m, want in ((0.95, 1, 3.8415), (0.99, 8, 20.0902), (0.5, 10, 9.3418)):
        assert N.chi_square_quantile(p, m) == pytest.approx(want, abs=1e-3)
