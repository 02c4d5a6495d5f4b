import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filingloom.llm import langid, mixing, neardup, pii, stages
from filingloom.llm.common import Scratch


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = {"en": "the cat sat on that mat with this hat and then ran".split(), "fr": "le chat noir dans une maison avec des amis et puis voilà".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "e", "ton"]) for _ in range(rng.randrange(5, 200)))
        rows.append((i, text, rng.choice([lang, None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text), 1, "k", 0.5))
    rows += [(1000, rows[0][1] + " extra", "en", "b", 1, 1, "k", 0.5), (1001, rows[0][1], "en", "a", 1, 1, "k", 0.5), rows[5], (1002, None, "en", "a", 1, 1, "k", 0.5), (1003, "", "en", "a", 1, 1, "k", 0.5), (1004, "123 456", "en", "a", 1, 1, "k", 0.5), (None, "a text without any id that is not a copy", "en", "b", 1, 1, "k", 0.5), (1005, "mail me at a1@b.cd the cat", "en", "b", 1, 1, "k", 0.5)]
    return documents(spark, rows)


def test_languages(spark, corpus):
    got = stages.keep_languages(corpus)
    assert got.columns == corpus.columns
    assert Counter(r.doc_id for r in corpus.collect()) - Counter(r.doc_id for r in got.collect()) == Counter({1002: 1, 1003: 1, 1004: 1})


def test_the_model_decides_which_languages_stay(spark, corpus):
    strange = documents(spark, [(2000, "η γάτα κάθισε στο χαλί με το καπέλο", None, "a", 1, 1, "k", 0.5), (2001, "кот сидел на ковре и потом убежал", None, "a", 1, 1, "k", 0.5)])
    both = corpus.unionByName(strange)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    everything = ids(stages.keep_languages(both))
    assert everything == ids(stages.keep_languages(corpus)) and not {2000, 2001} & set(everything)
    english = ids(stages.keep_languages(both, languages={"en"}))
    french = ids(stages.keep_languages(both, languages={"fr"}))
    assert english and french and english + french == everything
    # models that learned other labels keep other rows: one that knows Greek, and one to which the two languages are swapped
    greek = langid.LanguageIdentifier.fit(both.withColumn("lang", F.when(F.col("doc_id") == 2000, "el").otherwise(F.col("lang"))))
    assert 2000 in ids(stages.keep_languages(both, identifier=greek))
    swapped = langid.LanguageIdentifier.fit(corpus.replace({"en": "fr", "fr": "en"}, subset="lang"))
    assert ids(stages.keep_languages(both, languages={"en"}, identifier=swapped)) == french


def test_near_duplicates(spark, corpus):
    got = stages.drop_near_duplicates(corpus)
    assert got.columns == corpus.columns
    kept = {r.id for r in neardup.components(corpus).where("kept").collect()}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i in kept)
    assert 0 in kept and 1000 not in kept and 1001 not in kept


def test_personal_data(spark, corpus):
    got = {r.doc_id: r for r in stages.mask_personal_data(corpus).collect()}
    assert got[1005].text == "mail me at [EMAIL] the cat" and got[1002].text is None
    assert got[3] == next(r for r in corpus.collect() if r.doc_id == 3)


def test_mixture(spark, corpus):
    got = stages.mix_sources(corpus)
    assert got.columns == corpus.columns
    of = lambda rows: Counter((r.source, r.doc_id) for r in rows)
    assert max(of(got.collect()).values()) <= 6  # one row is repeated
    targets = {r.source: r.target for r in mixing.Mix(corpus, ["doc_id"], Scratch(spark, "t").write).targets.collect()}
    words = Counter()
    for r in got.collect():
        words[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text))
    assert all(abs(words[s] - t) < max(600, 0.15 * t) for s, t in targets.items())


def test_empty(spark, corpus):
    none = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (out.columns == none.columns or name == "BPE encoding")


def test_run_matches_a_plain_computation(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect() if r.text and re.search("[^\\W\\d_]", r.text)}
    # near duplicates by brute force
    sets = {}
    for i, t in rows.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((root(a), root(b)))
                least[q] = p
    kept = {i for i in ids if root(i) == i}
    got = corpus_pipeline.run(spark, folder)
    taken = Counter(r.doc_id for r in got.collect())
    assert set(taken) <= kept and max(taken.values()) <= 3
    from filingloom.llm.bpe import tree_bpe
    from filingloom.llm.queries import vocabulary_path

    weights = pii.fit(docs)
    for r in got.collect():
        assert r.n_tokens == len(tree_bpe(vocabulary_path()).encode(pii.masked(rows[r.doc_id], weights)))
