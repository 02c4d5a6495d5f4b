import zlib

import numpy as np

from filingloom.llm import langid


def brute(a: str, b: str) -> float:
    def own(text):
        text = "".join(c.lower() if c.isalpha() else " " for c in text)
        text = " " + " ".join(text.split()) + " "
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    x, y = own(a), own(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_kernel_matches_brute_force(monkeypatch):
    texts = ["The cat, sat on 12 mats!", "Élan vital été", "das ist — gut", "the mat", "a"]
    sample = [("x", langid.grams(t)) for t in texts]
    model = langid.fit(sample, 10)
    got = langid.kernel(model, model.presence(), [langid.grams(t) for t in texts])
    want = np.array([[brute(a, b) for b in texts] for a in texts])
    assert np.allclose(got, want, atol=1e-5)
    long = "Some words, and more. " * 40
    whole = langid.grams(long)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 50)
    assert np.array_equal(langid.grams(long), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97


def test_edges(spark):
    rows = [(0, "le chat noir", "fr", "a"), (1, "the black cat", "en", "b"), (3, None, "en", "c"), (4, "", None, None), (5, "12 :: 34", "en", "d"), (None, "the cat", None, "e"), (1, "the black cat", "en", "b"), (7, "chat " * 300_000, "fr", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert by[None].lang_pred == "en" and by[7].lang_pred == "fr"
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(99, 1)).replace("", None, "lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_ties_and_many_labels():
    same = [(label, langid.grams(text)) for label in ("b", "a") for text in ("one two three", "four five six")]
    identifier = langid.LanguageIdentifier(langid.fit(same))
    assert {identifier.predict_texts([t])[0][0] for t in ("one two", "six", "seven")} == {"a"}
    many = [(f"l{i:03d}", langid.grams(f"word{chr(0x4E00 + i)} {chr(0x4E00 + i)}{j}")) for i in range(200) for j in "xyz"]
    model = langid.fit(many)
    assert len(model.landmarks) <= langid.LANDMARKS
