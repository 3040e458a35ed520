import pytest

from folioweave.llm import mixture as M


def test_awards_follow_shares():
    got = M.award([0.5, 0.3, 0.2], [99, 99, 99], 10)
    assert [got.count(i) for i in range(3)] == [5, 3, 2]
    assert [M.award([0.5, 0.5], [2, 99], 10).count(i) for i in range(2)] == [2, 8]
    assert M.award([0.5, 0.5], [1, 1], 10) == [0, 1] and M.award([], [], 3) == []


def test_plan_takes_the_largest_mixture():
    quotas, size, seq = M.plan({"a": 1000, "b": 100}, [("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 1)], blocks=300)
    assert size * 300 == pytest.approx(600) and [q.blocks for q in quotas] == [200, 100, 0] and len(seq) == 300


def test_operator(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(i, "uno dos tres cuatro " * (1 + i % 7), " Gaceta" if i % 2 else "gaceta", 1) for i in range(600)] + [(1000 + i, "cinco seis", "manual", 1) for i in range(100)]
    rows += [(2000, None, "manual", 1), (2001, "", "manual", 1), (2002, "x", None, 1), (2003, "x", "other", 1), (None, "x", "manual", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, pass int")
    targets = spark.createDataFrame([("GACETA", 0.8, 1), ("manual", 0.15, 3), ("nobody", 0.05, 2), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, base = M.mixture(docs, targets, blocks=256)
    got = mix.collect()
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got) and {r.source for r in got} == {"gaceta", "manual"}
    assert not {2000, 2001, 2002, 2003} & {r.doc_id for r in got}
    shares = {r.source: r for r in M.shares(mix, base).collect()}
    assert abs(shares["gaceta"].reached_share - 0.8 / 0.95) < 0.02 and shares["nobody"].reached_share == 0
    assert shares["manual"].most_uses <= 3 and shares["gaceta"].most_uses == 1
    assert sorted(r.doc_id for r in M.mixture(docs, targets, blocks=256)[0].collect()) == sorted(r.doc_id for r in got)
    assert M.mixture(docs.limit(0), targets)[0].count() == 0 and M.mixture(docs, targets.limit(0))[0].count() == 0
