"""Source mixing, the archive and the URL filter against brute force, and on odd input."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from filingloom.llm import common, mixing, oracles, urltree, warc
from filingloom.llm.common import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def level_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = dict.fromkeys(names, 0.0)
    open_, left = set(names), float(total)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share >= most * sizes[s]]
        if not over:
            for s in open_:
                target[s] = weight[s] * share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def mix_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 size", "'x' n", "2 block")
    return mixing.Mix(docs, ["doc_id"], Scratch(spark, "mix").write)


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", None, "tiny", ""]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 80, 700, 3000]))), "a" if rng.random() < 0.4 else rng.choice(names)) for i in range(400)]
    rows += [(None, "one two", "b"), (5, None, "b"), (7, "x y z", "tiny"), (7, "x y z", "tiny"), (9, "", "none")]
    mix = mix_of(spark, rows)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = level_targets(sizes)
    found = {r.source: r.target for r in mix.targets.collect()}
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s], abs=1e-6) for s in want)
    taken = Counter()
    by_size = {r.source: r.source_size for r in mix.targets.collect()}
    assert by_size == dict(sizes)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[(r.source_size, r.target)] += r.taken
    for s, t in want.items():
        if sum(1 for o in want if (sizes[o], round(want[o], 6)) == (sizes[s], round(t, 6))) == 1:
            key = next(k for k in taken if k[0] == sizes[s] and k[1] == pytest.approx(t, abs=1e-6))
            assert abs(taken[key] - t) <= 4 * mixing.BLOCK
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_of(spark, rows).taken().collect()))
    slots = mix.scheduled().collect()
    spent = Counter()
    for r in slots:
        assert 0 <= r["from"] < r["to"]
        spent[r.doc_id] += r["to"] - r["from"]
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.taken
    assert +spent == +wanted


def test_the_schedule_keeps_the_shares_all_along(spark):
    shares = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 1.0)], "n long, target double")
    rows = mixing.schedule(shares, 4000).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(4000))
    seen = Counter()
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.n]
        seen[r.n] += 1
        assert all(abs(seen[n] - i * w / 8) < 6 for n, w in ((0, 5), (1, 2), (2, 1)))


def test_mixing_of_nothing(spark):
    assert mix_of(spark, [(1, "a", "s")][:0] or [(1, None, "s")]).taken().first().taken == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.Mix(docs, ["doc_id"], Scratch(spark, "mix").write).taken().count() == 0
    assert [r.taken for r in mix_of(spark, [(1, "a b c", None)]).taken().collect()] == [3]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' address", "1 digest")


def test_archive(spark):
    rng = random.Random(1)
    bodies = [None, "", "same body", "ünï", "x" * 5000]
    rows = [(i * 3, f"http://h/{i}", rng.choice(bodies)) for i in range(60)] + [(1000, None, "same body"), (None, "u", "same body"), (None, "u", "lonely"), (None, "v", "lonely"), (6, "again", "z"), (6, "again", "z")]
    got = warc.archive(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.archive(pages(spark, rows).limit(0)).count() == 0


def test_archive_keeps_payloads_once_and_rebuilds_records(spark):
    rows = [(1, "http://a\r\nX: y", "body"), (2, "http://b", "body"), (3, "http://c", "ab")]
    records, payloads = warc.write(pages(spark, rows), Scratch(spark, "warc"), minimum=3)
    assert payloads.count() == 2
    full = {r.page_id: bytes(r.record) for r in warc.originals(records, payloads).collect()}
    assert full[1].endswith(b"\r\n\r\nbody\r\n\r\n") and full[1].startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://a%0D%0AX: y\r\n")
    assert b"WARC-Refers-To: <urn:page:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" in full[2]
    assert {r.page_id: r.u for r in records.select("page_id", warc.target().alias("u")).collect()} == {i: u for i, u, _ in rows}
    plan = warc.rebuilt(records, payloads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan  # of the headers
    spoiled = payloads.selectExpr("address", "cast('other' as binary) payload")
    with pytest.raises(Exception, match="doesn't match its address"):
        warc.read(records, spoiled).collect()


def test_archive_of_other_ids_and_long_payloads(spark):
    long = "ü" * 3_000_000
    rows = [("a>b c", "u", long), ("z/ü", "u", long), ("m", None, ""), ("n\nx", "v", None)]
    table = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.archive(table).collect()}
    assert got["z/ü"].refers_to == "a>b c" and got["a>b c"].refers_to is None and got["z/ü"].payload_bytes == 6_000_000
    assert got["n\nx"].refers_to == "m" and got["m"].record_type == "response"
    dated = warc.write(table.withColumn("at", F.lit("2024-02-03T04:05:06Z")), Scratch(spark, "warc"), date=F.col("at"))[0]
    assert {r.d for r in dated.select(warc.field("WARC-Date").alias("d")).collect()} == {"2024-02-03T04:05:06Z"}


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Org/x", "https://a.example.ORG/es/1", "https://example.org/en/12?q=1", "https://example.org/en/2#f", "ftp://x.com/fr/", "http://com/de/", "http://xcom/de/", "http://y.com", "http://y.com/fr", "://h/p", "http://u@y.com:80/de/1", "http://a://b/c", "http://ÄB.com/fr/é"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, None), (None, "http://x.com/de/9")]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'a' host", "1 share")
    got = {r.page_id: r for r in urltree.judge(table).collect()}
    assert urltree.judge(table).count() == len(rows)
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for h, p, v in urltree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1]), u
        assert got[i].verdict == (best[2] or ("block" if got[i].share > 0.5 else "allow")), u
    assert urltree.judge(table.limit(0)).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rules = (("shop.test", "/ads/1", "block"), ("shop.test", "/news/1", "allow"))
    urls = [f"http://shop.test/ads/{i}" for i in range(1, 30)] + [f"http://shop.test/news/{i}" for i in range(1, 30)] + [f"http://other.test/ads/{i}" for i in range(9)]
    got = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    verdicts = defaultdict(set)
    for r in got:
        if r.rule is None:
            verdicts[r.host + r.path.rsplit("/", 1)[0]].add(r.verdict)
    assert verdicts == {"shop.test/ads": {"block"}, "shop.test/news": {"allow"}, "other.test/ads": {"block"}}  # equal templates carry labels to hosts without any


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    return db.execute(oracles.URL_FILTER).fetchall()


@pytest.mark.parametrize("seed", range(3))
def test_url_tree_against_sql(spark, seed):
    rng = random.Random(seed)
    hosts = ["example.org", "a.example.org", "b.example.com", "x.com", "c.net", "d.example.net", ""]
    words = ["es", "en", "fr", "de", "blog", "*", "**", "1", "a2", "é", "shop"]
    rows = [(i, f"http://{rng.choice(hosts) if rng.random() < 0.7 else 'x.com'}/" + "/".join(rng.choice(words[: rng.randrange(2, 12)]) for _ in range(rng.randrange(6)))) for i in range(600)]
    rows += [(1, None), (2, "no scheme"), (None, "http://x.com/de/1"), (None, "http://x.com/de/1"), (700, "http://x.com/" + "a/" * 20_000), (701, "http://x.com/" + "b" * 100_000), (702, "http://c.net" + "/en" * 40)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'a' host", "1 share", "'k' `key`")
    got = [tuple(r) for r in urltree.judge(table).select("page_id", "host", "path", "rule", "verdict", "template", "share").collect()]
    near = lambda rows: Counter((*r[:6], round(r[6], 5)) for r in rows)
    assert near(got) == near(by_sql(rows)) and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_alike_branches_are_told_by_counts(spark):
    # 0.249 and 0.251 of many urls are alike, 1 and 0 of forty aren't, 1 and 0 of two can't be told apart
    test = lambda *c: spark.range(1).selectExpr(*[f"{v} as {n}" for n, v in zip("xntm", c)]).select(urltree.alike("x", "n", "t", "m")).first()[0]
    assert test(249, 1000, 500, 2000) and not test(0, 20, 20, 40) and test(0, 1, 1, 2) and test(0, 0, 5, 9) and test(3, 9, 3, 9)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(30)] + [(None, 1), ("lost", 1)], "k string, v int")
    small = rows.where("k <> 'lost'").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    for how in ("inner", "left"):
        got = common.join_by_size(rows, small, "k", size="n", total=332, how=how)
        want = rows.join(small.drop("n"), "k", how)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_small_sources_reach_their_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03d}": rng.choice([1, 20, 40, 60, 130, 700, 1500]) for i in range(60)} | {"large": 200_000, "larger": 500_000}
    if seed:
        sizes = {k: v for k, v in sizes.items() if v < 2000}
    rows = []
    for s, n in sizes.items():
        while n > 0:
            k = min(n, rng.choice([1, 7, 30, 400]) if sizes[s] < 2000 else 5000)
            rows.append((len(rows), "w " * k, s))
            n -= k
    want = level_targets(sizes)
    mix = mix_of(spark, rows)
    of = {i: s for i, _, s in rows}
    taken, spent = Counter(), Counter()
    for r in mix.taken().collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    for r in mix.scheduled().collect():
        assert 0 <= r["from"] < r["to"] and 0 <= r.slot < max(1, mix.slots)
        spent[r.source] += r["to"] - r["from"]
    assert +spent == +taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, 0.01 * t), (s, sizes[s], t, taken[s])


def test_small_sources_stay_in_the_stage(spark):
    from filingloom.llm import stages

    rows = [(i, "w " * 40, f"s{i:03d}") for i in range(30)] + [(100 + i, "w " * 5000, "large") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in stages.mix_sources(docs).collect())
    assert all(got[i] == 3 for i in range(30))
