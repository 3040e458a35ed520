import random

import numpy as np

from folioweave.llm import neardup as N


def brute(rows, rule):
    sets = [(i, rule.set_of(t)) for i, t in rows if t is not None and i is not None and len(rule.units(t)) >= max(rule.run, rule.min_words)]
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and len(a & b) / len(a | b) >= rule.threshold:
                out.add((min(i, j), max(i, j)))
    return out


def texts(seed=3):
    rnd = random.Random(seed)
    words = [f"p{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = rnd.choices(words, k=rnd.randint(25, 90))
        rows.append((f"g{g}-0", " ".join(base)))
        for c in range(rnd.randint(0, 3)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((f"g{g}-{c + 1}", ("\n" if c else " ").join(w).upper() if c == 2 else " ".join(w)))
    rows += [("dup", rows[0][1]), ("dup", rows[0][1]), ("null", None), ("", ""), ("short", "uno dos"), (None, rows[1][1]), ("long", "palabra larga sí " * 30_000)]
    return rows


def test_pairs_of_words(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id string, text string, rid int, t1 string")
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, "id", "text", N.CHUNK_RULE).collect()}
    want = brute(rows, N.CHUNK_RULE)
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)


def test_pairs_of_characters(spark):
    rows = [("a", "Ley de aguas nacionales"), ("b", "ley de aguas nacionales"), ("c", "Ley de agua nacional"), ("d", "xy"), ("e", "xy"), ("f", "   "), ("g", "Código civil"), ("h", "Ley de aguas\nnacionales")]
    df = spark.createDataFrame(rows, "id string, title string")
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df, "id", "title", N.TITLE_RULE).collect()} == brute(rows, N.TITLE_RULE)
    assert N.similar_pairs(df.limit(0), "id", "title", N.TITLE_RULE).count() == 0


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"{k:03}", " ".join(base[:30] + [f"x{k}"] + base[30:])) for k in range(150)]
    got = N.similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text", N.CHUNK_RULE)
    assert got.count() == 150 * 149 // 2


def test_hot_paths_change_nothing(spark, monkeypatch):
    rows = texts(9)
    df = spark.createDataFrame(rows, "id string, text string")
    monkeypatch.setattr(N, "HOT_SEEN", 2)
    monkeypatch.setattr(N, "HOT_ROWS", 2)
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, "id", "text", N.CHUNK_RULE).collect()}
    want = brute(rows, N.CHUNK_RULE)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_groups(spark):
    rows = texts()
    df = spark.createDataFrame([r for r in rows if r[0] != "dup"], "id string, text string")
    got = {r.id: (r.group_id, r.links) for r in N.groups(df, "id", "text", N.CHUNK_RULE).collect()}
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs(df, "id", "text", N.CHUNK_RULE).collect()}
    parent = {i: i for i in got}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert {i: g for i, (g, _) in got.items()} == {i: top(i) for i in got}
    assert all(n == sum(i in p for p in pairs) for i, (_, n) in got.items())


def test_long_chain_is_one_component(spark):
    # neighbours on the chain have distant numbers, so that no vertex learns from the order
    step, n = 7_919, 100_000
    edges = spark.range(n).selectExpr(f"id * {step} % {n} AS a", f"(id + 1) * {step} % {n} AS b").where(f"a <> {step * 50_000 % n}")
    got = N.components(edges.unionByName(spark.createDataFrame([(200_001, 200_000), (200_000, 200_002), (200_000, 200_000)], "a bigint, b bigint")))
    sizes = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert got.select("v").distinct().count() == got.count() == n + 3
    assert len(sizes) == 2 and sizes[0] == n and sizes[200_000] == 3
    assert N.components(edges.limit(0)).count() == 0


def test_copies_in_shares(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"{k:02}", base) for k in range(20)] + [(f"b{k}", base + " fin") for k in range(7)] + [("b0", base + " fin")]
    want = brute(rows, N.CHUNK_RULE)
    monkeypatch.setattr(N, "SHARE_OF_CLASS", 3)
    got = [(r.id_a, r.id_b) for r in N.similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text", N.CHUNK_RULE).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_splits_lose_no_recall():
    # pairs at the threshold in buckets that are split again and again: the share that meets in a run, and so in one of the runs
    rng = np.random.default_rng(5)
    n, s = 1500, 0.5
    one, other = (rng.integers(0, 16, (n, N.SKETCH), dtype=np.uint8) for _ in range(2))
    two = np.where(rng.random((n, N.SKETCH)) < s, one, other).astype(np.uint8)
    sketch = N.pack(np.concatenate([one, two]))
    met = np.zeros(n)
    for run in range(40):
        path = np.full(2 * n, 977 + run, np.uint64)  # all in one bucket
        hit = set()
        for a, b in N.candidate_pairs(path, sketch, N.CHUNK_RULE.shared):
            for x, y in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()):
                if y - x == n:
                    hit.add(x)
        met[list(hit)] += 1
    passed = (one == two).sum(1) >= N.CHUNK_RULE.shared
    recall = 1 - (1 - s * met[passed] / 40) ** N.CHUNK_RULE.runs
    assert recall.mean() > 0.998


def test_buckets_that_stay_alike_are_compared_once():
    sketch = np.random.default_rng(2).integers(0, 256, N.WIDTH, dtype=np.uint8)[None, :].repeat(400, 0)
    sketch[np.arange(400), np.arange(400) % N.WIDTH] ^= 1
    got = [np.minimum(a, b) * 400 + np.maximum(a, b) for a, b in N.candidate_pairs(np.full(400, 3, np.uint64), sketch, N.CHUNK_RULE.shared)]
    got = np.concatenate(got)
    assert len(np.unique(got)) == len(got) == 400 * 399 // 2
