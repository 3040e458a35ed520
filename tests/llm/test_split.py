from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm import split as S


def joined(parts):
    return "".join(p[lead:] for p, _, lead in parts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,;:\nÁ́I)", max_size=400), st.integers(-2, 60), st.integers(-1, 40))
def test_pieces_join_to_the_text(text, limit, overlap):
    parts = S.split_text(text, limit, overlap)
    assert joined(parts) == text
    if len(text) > max(2, limit):
        assert all(len(p) <= max(2, limit) for p, _, _ in parts)
        want = max(0, min(overlap, (max(2, limit) - 1) // 2))
        for (_, _, _), (p, at, lead) in zip(parts, parts[1:]):
            assert text[at : at + len(p)] == p and lead == min(want, at + lead)
    else:
        assert parts == [(text, 0, 0)]


def test_cuts_fall_at_headings_and_sentences():
    text = "Artículo 1.- Uno dos tres. Cuatro cinco.\nArtículo 2.- Seis siete ocho nueve."
    assert [p for p, _, _ in S.split_text(text, 50, 0)] == [text[:41], text[41:]]
    assert [p for p, _, _ in S.split_text("X" * 100, 40, 0)] == ["X" * 25] * 4
    long = "palabra " * 100_000
    assert joined(S.split_text(long, 900, 80)) == long


CHUNKS = "id string, chunkType string, articleRef string, text string, max_chars string, pieces string"


def test_operator(spark):
    limits = spark.createDataFrame([("generic", 20, 4), ("Article", 30, 5), ("article", 35, 5), ("bad", None, 1)], "chunktype string, max_chars int, overlap_chars int")
    rows = [
        ("a", " ARTICLE ", "Artículo 1", "palabras y más palabras. Otras más.", "x", "y"),
        ("a", " ARTICLE ", "Artículo 1", "palabras y más palabras. Otras más.", "x", "y"),
        ("b", None, None, "z" * 21, "x", "y"),
        ("c", "unlisted", None, "z" * 20, "x", "y"),
        ("d", "article", None, None, "x", "y"),
        ("e", "article", None, "", "x", "y"),
        (None, "article", None, "z" * 90, "x", "y"),
    ]
    df = spark.createDataFrame(rows, CHUNKS)
    got = S.split_oversized(df, limits).collect()
    assert {r.chunk_id for r in got} == {"a", "b"} and len(got) == 4
    assert [r.chunkType for r in got if r.chunk_id == "a"] == [" ARTICLE "] * 2
    assert {r.chunk_id for r in S.oversized_ids(df, limits).collect()} == {"a", "b"}
    assert S.split_oversized(df, limits.limit(0)).count() == 0
    assert S.split_oversized(df.limit(0), limits).count() == 0
