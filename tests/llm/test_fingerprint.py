import hashlib
import random

import numpy as np

from filingloom.llm import fingerprint as fp


def test_order_and_increments():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    whole = fp.fingerprint("\n".join(lines))
    mixed = lines[:]
    rng.shuffle(mixed)
    assert np.array_equal(whole, fp.fingerprint("\n\n".join(mixed)))
    part = fp.fingerprint("\n".join(lines[:20]))
    assert np.array_equal(fp.insert(part, "\n".join(lines[20:])), whole)
    assert np.array_equal(fp.delete(whole, "\n".join(lines[20:])), part)
    assert np.array_equal(fp.from_text(fp.to_text(whole)), whole)
    assert not np.array_equal(fp.fingerprint("a\na"), fp.fingerprint("a"))
    assert np.array_equal(fp.fingerprint(None), fp.zero()) and np.array_equal(fp.fingerprint("\n\n"), fp.zero())


def test_blocks_do_not_matter(monkeypatch):
    text = "The quick brown fox jumps\nover the lazy dog, again and again.\nshort\n" * 30
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "BLOCK", 37)
    assert np.array_equal(fp.fingerprint(text), whole)


def slow_likeness(a, b):
    """Cosine of signed counts of windows, window by window, from the definition."""
    if sorted(fp.paragraphs(a)) == sorted(fp.paragraphs(b)):
        return 1.0

    def lanes(text):
        out = [0] * fp.LIKE
        for p in fp.paragraphs(text):
            p = p.ljust(fp.WINDOW, b"\0")
            for i in range(len(p) - fp.WINDOW + 1):
                x, y = int.from_bytes(p[i : i + 8], "little"), int.from_bytes(p[i + 8 : i + 16], "little")
                m = (x * int(fp.MIX[0])) % 2**64 ^ (y * int(fp.MIX[1])) % 2**64
                m ^= m >> 29
                m = m * int(fp.MIX[2]) % 2**64 >> 55
                out[m % fp.LIKE] += 1 if m >= fp.LIKE else -1
        return out

    x, y = lanes(a), lanes(b)
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return min(max(sum(v * w for v, w in zip(x, y)) / norm, 0.0), 0.999999) if norm else 0.0


def test_likeness_from_its_definition(spark):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(["alpha", "beta", "é", "x", "gamma"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(8))) for _ in range(40)] + ["", None, "abc", "a line\n" * 3]
    rows = {r.doc_id: r for r in fp.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        assert abs(rows[i].near_edited - slow_likeness(t, fp.edited(t, after))) < 1e-9 and abs(rows[i].near_next - slow_likeness(t, after)) < 1e-9


def test_likeness_of_very_long_texts():
    for length in (10**4, 10**5, 10**6, 10**7):
        for period in ("z", "sixteen letters ", "a line of text that repeats\n"):
            text = period * (length // len(period))
            changed = fp.edited(text, "something quite different, over and over again. " * (length // 48))
            assert fp.likeness(fp.fingerprint(text), fp.fingerprint(changed)) > 0.7, (length, period)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.to_text(fp.fingerprint(t)), fp.to_text(fp.fingerprint(changed))))
    return out


def test_chain_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_BYTES", 1)
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), rng.choice([None, "", "é", "a longer text " * rng.randrange(40)])) for _ in range(400)]
    rows += [(None, "null id"), (rows[0][0], "tie"), rows[1], (99, "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' bucket", "1 closing").repartition(7)
    got = [tuple(r)[:5] for r in fp.compare(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_small_inputs(spark):
    docs = spark.createDataFrame([(5, "only one text of some length")], "doc_id long, text string")
    (row,) = fp.compare(docs).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == brute([(5, "only one text of some length")])[0][2]
    assert fp.compare(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs).count() == 1


def test_likeness_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in fp.compare(docs).collect() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in rows]) > 0.6 > 0.3 > np.median([r.near_next for r in rows])
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_likeness_of_a_line_repeated_often():
    line, other = "The same line of a very long text.\n", "Quite another line that is as long\n"
    for n in (30_000, 100_000):
        text = line * n
        changed = fp.edited(text, other * n)
        a, b = fp.fingerprint(text), fp.fingerprint(changed)
        assert 0.9 < fp.likeness(a, b) < 1 and fp.likeness(a, fp.fingerprint(other * n)) < 0.5
        assert np.array_equal(fp.delete(fp.insert(a, changed), changed), a)
