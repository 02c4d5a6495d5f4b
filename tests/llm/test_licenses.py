import random
import re

import zstandard

from filingloom.llm import licenses


def test_planted_notices():
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("the of and thion erand inghe license permission to".split()) for _ in range(n))
    for name, text in licenses.TEMPLATES:
        body = f"{filler(80)}.\n{text}.\n{filler(500)}."
        (got,) = licenses.find(body)
        assert got[0] == name and body[got[1] : got[2]].split()[0] == text.split()[0]
        assert text.startswith(body[got[1] : got[2]][:20]) and got[4] == got[5] == 0


def test_wording():
    mit = licenses.TEMPLATES[4][1]
    assert [f[0] for f in licenses.find(mit.replace("the Software", "the Program"))] == ["MIT"]
    assert licenses.find("Licensed under CC BY-ND 4.0.") == []
    assert licenses.find("Licensed under the Apache License, Version 3.0.") == []
    assert licenses.find("You need a license to drive; permission is granted by the office.") == []
    wrapped = re.sub(r"(.{60}\S*) ", "\\1\n# ", licenses.TEMPLATES[1][1])
    assert [f[0] for f in licenses.find(wrapped)] == ["Apache-2.0"]
    twice = "Released under the MIT License.\nwords\nLicensed under CC BY 4.0. Released under the MIT License."
    assert [f[0] for f in licenses.find(twice)] == ["MIT", "CC-BY-4.0", "MIT"]


def test_long_texts_and_edges(spark):
    far = "x " * 400_000 + "\nReleased under the MIT License.\n" + "license " * 20_000
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, far, "c"), (None, "Licensed under CC BY 4.0", "d"), (4, "İ Released under the MIT License", "e")], "doc_id long, text string, license string")
    got = sorted((str(r.doc_id), r.license) for r in licenses.scan(docs).collect())
    assert got == [("3", "MIT"), ("4", "MIT"), ("None", "CC-BY-4.0")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_all_lines_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {r.doc_id for r in docs.collect() if re.search("Apache License, Version 2.0|CC BY-NC 4.0|GNU General Public License, version 3|the MIT License", r.text)}
    assert {r.doc_id for r in licenses.scan(docs).collect()} == lines


def test_several_notices_in_a_line():
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) <= licenses.SHORT]
    for n, t in short:
        for m, u in short:
            if t not in u and u not in t:
                assert [f[0] for f in licenses.find(f"Text: {t}. Code: {u}.")] == [n, m]
    amid = "ontion thand " * 50
    assert [f[0] for f in licenses.find(f"{amid}Licensed under CC BY 4.0 {amid}Released under the MIT License {amid}")] == ["CC-BY-4.0", "MIT"]


def test_changed_copies_beside_exact_ones():
    for name, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) <= 60:
            continue
        early, late = words[:], words[:]
        early[3] = early[10] = "changed"
        late[-4] = late[-11] = "changed"
        kinds = [" ".join(w) for w in (words, early, late)]
        for a in kinds:
            for b in kinds:
                for c in kinds:
                    got = licenses.find("\n".join(["some words before", a, "third party", b, "more of it", c, "the end"]))
                    assert [f[0] for f in got] == [name] * 3, (name, kinds.index(a), kinds.index(b), kinds.index(c))


def plain_words(text):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+(?:[.'+-][A-Za-z0-9]+)*", text)]


def test_short_notices_against_every_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    short = [(n, [w for w, _, _ in plain_words(t)]) for n, t in licenses.TEMPLATES if len(t.split()) <= licenses.SHORT]
    want = set()
    for r in docs.collect():
        words = plain_words(r.text or "")
        own = [w for w, _, _ in words]
        hits = sorted((-len(t), words[i][1], words[i + len(t) - 1][2], n) for n, t in short for i in range(len(own) - len(t) + 1) if own[i : i + len(t)] == t)
        taken = []
        for _, a, b, n in hits:
            if not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                want.add((r.doc_id, n, a, b, 0, 0))
    got = {(r.doc_id, r.license, r.start, r.end, r.missing, r.added) for r in licenses.scan(docs).collect()}
    assert got == want and len(want) > 30


def test_gain_and_differences_of_changed_texts():
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    rng = random.Random(7)
    for name, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) <= 40:
            continue
        for changes in (0, 1, 2, 3):
            own = words[:]
            places = [k for k in range(5, len(words) - 5, 4) if re.fullmatch("[A-Za-z]+", words[k])]
            for k in rng.sample(places, changes):
                own[k] = f"other{k}"
            body = " ".join(own)
            if 2 * changes > licenses.TOLERANCE * len(plain_words(text)):
                assert licenses.find(body) == []
                continue
            ((got, start, end, gain, missing, added),) = licenses.find(body)
            assert (got, start, end) == (name, plain_words(body)[0][1], plain_words(body)[-1][2])
            assert missing == added == changes
            data, dictionary = body.lower().encode(), zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            helped = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False)
            alone = len(plain.compress(data))
            size = min(alone, len(plain.compress(text.lower().encode())))
            assert gain == round((alone - len(helped.compress(data))) / size, 4) and gain > 0.5


def test_equal_gains_and_repeated_rows(spark):
    text = "Released under the MIT License. Released under the MIT License."
    found = licenses.find(text)
    assert [f[:3] for f in found] == [("MIT", 0, 30), ("MIT", 32, 62)]
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert licenses.scan(docs).count() == 4


def test_notices_in_sequence():
    long = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) > licenses.SHORT]
    assert [f[0] for f in licenses.find("\n".join(t for _, t in long))] == [n for n, _ in long]
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) <= licenses.SHORT]
    for between in (" ", "\n"):
        assert [f[0] for f in licenses.find(between.join(f"{t}." for _, t in short))] == [n for n, _ in short]
