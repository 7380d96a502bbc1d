"""Any number of language values."""

from cairn.llm import langid


def test_many_values_learn_the_most_frequent(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(40)] + [(100 + i, "der Hund lag auf dem Tisch", "de") for i in range(30)] + [(1000 + i, "zzz", f"x{i:03d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, prob = langid.learn(docs, max_languages=3)
    assert langs == ["de", "en", "x000"] and prob.shape == (langid.BUCKETS, 3)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langs, prob).collect()}
    assert got[0] == "en" and got[100] == "de" and len(got) == len(rows)
    assert len(langid.learn(docs)[0]) == 100
