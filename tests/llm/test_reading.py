import numpy as np

from folioweave.llm import reading as R

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{D}/reading_samples.parquet").orderBy("sample_id").collect()
    surprisal, unknown = R.corpus_surprisal(spark.read.parquet(f"{D}/documents.parquet"))
    levels = np.array([r.reading_level for r in rows])
    got = R.cross_validate(R.Measure(surprisal, unknown).rows([r.text for r in rows]), levels, [1.0])[1.0]
    assert (got == levels).mean() >= 0.93 and np.abs(got - levels).max() <= 1


PLAIN = "El consejo podrá autorizar el recurso. La usuaria deberá pagar la cuota, siempre que exista."


def test_form_has_no_influence():
    m = R.Measure({}, 5.0)
    others = [PLAIN.upper(), PLAIN.replace(" ", "  "), PLAIN.replace("autorizar el", "autorizar\nel"), "- " + PLAIN, "Artículo 3.- " + PLAIN, PLAIN.replace(". ", ".\r\n"), PLAIN + "\0"]
    rows = m.rows([PLAIN, *others])
    assert np.allclose(rows[0], rows[1:], atol=0.05)
    a, b, c = m.rows(["", "123 456", "..."])
    assert (a == b).all() and (b == c).all() and m.rows([]).shape == (0, len(R.FEATURES))


def test_features_by_hand():
    m = R.Measure({"uno": 1.0, "dos": 2.0}, 5.0)
    text = "Uno dos. Uno, porque dos!\nTres tres tres tres"
    got = m.rows(["x", text, " " + text])[1]
    sizes = [len("\0uno dos"), len(" uno, porque dos"), len(" tres tres tres tres") ]
    want = [4 / 9 + 2 / 9, (1 + 2 + 1 + 5 + 2 + 20) / 9, 1 / 9, np.log1p(2 / 3), np.log1p(9 / 3), (3 * 4 + 6 + 16) / 9, np.log1p(sizes[1])]
    assert np.allclose(got, want, atol=0.06), (got, want)
    long = m.rows([" ".join(f"{'abcdefgh'[i % 8]}x" for i in range(120)), " ".join(["a"] * 100 + [f"b{c}" for c in "abcdefghijklmnopqrst"])])
    assert np.isclose(long[0][0], 8 / 50) and np.isclose(long[1][0], (1 / 50 + 1 / 50 + 21 / 50) / 3)  # the last words count


def test_slices_measure_alike():
    m = R.Measure({}, 5.0)
    texts = [PLAIN * k for k in range(1, 9)] + ["", "a", "\n", "uno\ndos"]
    assert np.allclose(m.rows(texts), np.concatenate([m.rows([t]) for t in texts]))


def test_operator(spark):
    samples = spark.read.parquet(f"{D}/reading_samples.parquet")
    rows = [(1, "El vecino usa el papel. La doctora lee. Así se hace.", 9), (2, None, 9), (3, "", 9), (4, " \n\t ", 9), (5, "123 456", 9), (6, "Con arreglo a los principios que rigen la inoponibilidad, siempre que no se menoscabe la esfera jurídica, " * 3000, 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, reading_level int")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, samples).collect()}
    assert set(got) == {1, 5, 6} and got[1] == 1 and got[6] == 5
    assert R.reading_levels(docs, samples.limit(0)).count() == 0 and R.reading_levels(docs.limit(0), samples).count() == 0
