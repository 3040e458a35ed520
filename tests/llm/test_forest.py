import numpy as np

from folioweave.llm import forest as N


def rows(n=3000, clusters=60, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, 64))
    x = c[rng.integers(0, clusters, n)] + 0.25 * rng.standard_normal((n, 64))
    return [(f"id{i}", v.tolist(), "x") for i, v in enumerate(x * rng.uniform(0.5, 2, (n, 1)))]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "RANGE_ROWS", 500)
    data = rows()
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    junk = [("null", None, ""), ("short", [1.0] * 32, ""), ("empty", [], ""), ("zero", [0.0] * 64, ""), ("nan", [float("nan")] * 64, ""), (None, data[0][1], "")]
    df = spark.createDataFrame(data + [data[7], data[7]] + junk, "id string, embedding array<float>, key string")
    got = N.named_neighbours(df, "id", "embedding").collect()
    assert {r.id for r in got} == {i for i, _, _ in data}
    assert all(r.id != r.neighbour for r in got) and len(got) == 5 * len(data)
    near = {(r.id, r.neighbour) for r in got}
    hit = np.mean([(f"id{i}", f"id{j}") in near for i in range(len(data)) for j in top[i]])
    assert hit >= 0.95
    pairs = N.neighbour_pairs(df, "id", "embedding").collect()
    assert {(r.id_a, r.id_b) for r in pairs} == {(min(p), max(p)) for p in near} and len(pairs) == len(set(pairs))


def test_few_equal_and_no_rows(spark):
    same = [(f"s{i}", [1.0] * 64) for i in range(2000)]
    df = spark.createDataFrame(same, "id string, embedding array<float>")
    got = N.named_neighbours(df, "id", "embedding")
    assert got.count() == 10_000 and got.where("similarity < 0.999").count() == 0
    assert N.neighbour_pairs(df.limit(1), "id", "embedding").count() == 0
    assert N.neighbour_pairs(df.limit(3), "id", "embedding").count() == 3
    assert N.neighbour_pairs(df.limit(0), "id", "embedding").count() == 0


def test_prefix_lengths_hold_the_wanted_rows(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = rng.integers(-(1 << 62), 1 << 62, len(x))
    monkeypatch.setattr(N, "WANTED", 300)
    forest = N.grow(x, keys, len(x), 3)
    strings = [t.strings(x, keys) for t in forest]
    length = N.prefix_lengths(forest, strings, len(x)).astype(np.int64)

    def held(level):
        return sum(b - a for a, b in (N.stretch_of(s, level, t.sample) for t, s in zip(forest, strings)))

    assert (held(length) >= 300).all() and (held(length + 1)[length < 52] < 300).all()
    # of many more rows than the sample tells, the length grows by halving
    far = N.prefix_lengths(forest, strings, len(x) * 1024).astype(np.int64)
    assert (far >= length).all() and np.median(far - length) >= 6


def test_stretches_share_their_prefix():
    among = np.sort(np.random.default_rng(1).integers(0, 1 << N.BITS, 500))
    for level in (0, 3, 8, 20):
        a, b = N.stretch_of(among, np.full(500, level), among)
        assert all((among[x:y] >> (N.BITS - level) == v >> (N.BITS - level)).all() and y > x for v, x, y in zip(among, a, b))
        assert level or ((a == 0) & (b == 500)).all()


def test_bisected_numbers():
    p = np.random.default_rng(2).standard_normal((300, 8)).astype(np.float32)
    got = N.bisected(p, np.random.default_rng(0))
    assert sorted(got) == list(range(300)) and sorted(N.bisected(np.ones((5, 3), np.float32), np.random.default_rng(0))) == list(range(5))
