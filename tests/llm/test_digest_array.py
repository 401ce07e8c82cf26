import random

import pytest
import xxhash
from pyspark.sql import functions as F

from plantpulse.llm import digest_array
from plantpulse.llm.digest_array import RULES, DigestArrays, SortedDigests, judge_urls
from plantpulse.llm.registry import URL_RULES

URLS = [
    None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1?x=/fr/#y", "http://example.com",
    "http://example.com/", "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/x",
    "http://badexample.com/en/", "http://m.example.net/es/1", "http://example.net/en/1", "http://net/fr/",
    "http://.net/fr/", "http://a..net/fr/q#://", "x://y.org://net/es/", "http://com?/", "http://com/",
    "http://com:80/", "http://ÄÖ.com/é", "http://a.net/ES/", "http://a.com/\n/en/", "http://" + "a." * 3000 + "com/" + "p" * 50_000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain(url, rules, otherwise="allow"):
    host, path = split(url)
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def judged(df):
    return [(r["url"], tuple(r["judged"])) for r in df.collect()]


@pytest.mark.parametrize("array_rows", [digest_array.ARRAY_ROWS, 0])
def test_rules_equal_a_plain_search(spark, array_rows):
    pages = spark.createDataFrame([(u,) for u in URLS + URLS[:5]], "url string")
    got = judged(judge_urls(pages, spark.createDataFrame(URL_RULES, RULES), array_rows=array_rows))
    assert sorted(got, key=str) == sorted([(u, plain(u, URL_RULES)) for u in URLS + URLS[:5]], key=str)


@pytest.mark.parametrize("array_rows", [digest_array.ARRAY_ROWS, 0])
def test_many_random_rules(spark, array_rows):
    draw = random.Random(3)
    host = lambda: ".".join(draw.choice("abcdefghijklmnop") + draw.choice("xy") for _ in range(draw.randint(2, 4)))
    path = lambda: "".join(draw.choice(["/", "x", "yy", "é"]) for _ in range(draw.randint(0, 5)))
    rules = list({(host(), path()): draw.choice(["allow", "block"]) for _ in range(300)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"https://{host()}{'/' + path() if draw.random() < 0.9 else ''}" for _ in range(800)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string").repartition(5)
    got = judged(judge_urls(pages, spark.createDataFrame(rules, RULES), otherwise="?", array_rows=array_rows))
    assert sorted(got) == sorted((u, plain(u, rules, "?")) for u in urls)
    assert len({v[3] for _, v in got}) == 3


@pytest.mark.parametrize("array_rows", [digest_array.ARRAY_ROWS, 0])
def test_odd_rules_and_tables(spark, array_rows):
    odd = [("COM", None, "block"), ("com", "", "allow"), ("", "/", "block"), (None, "/", "block"), ("org", "/", None)]
    pages = spark.createDataFrame(
        [(1, "http://a.com/x", "keep"), (2, "http://b.org/", None)], "judged long, url string, host string"
    )
    out = judge_urls(pages, spark.createDataFrame(odd, RULES), array_rows=array_rows)
    assert out.columns == ["judged", "url", "host", "judged_"]
    got = {r["judged"]: (r["host"], r["judged_"]["rule"], r["judged_"]["verdict"]) for r in out.collect()}
    assert got == {1: ("keep", "com", "allow"), 2: (None, None, "allow")}
    none = judge_urls(pages, spark.createDataFrame([], RULES), otherwise="block", array_rows=array_rows)
    assert [r["judged_"]["verdict"] for r in none.collect()] == ["block", "block"]
    assert judge_urls(pages.limit(0), spark.createDataFrame(odd, RULES), array_rows=array_rows).count() == 0


def test_a_key_counts_only_with_its_string(monkeypatch, tmp_path, spark):
    """All digests collide, and still every string finds its own."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s, seed: 7)
    rules = spark.createDataFrame([(f"h{n}.com", "/", "block" if n % 2 else "allow") for n in range(50)], RULES)
    place = tmp_path / "arrays"
    place.write_bytes(digest_array._packed(rules.toArrow()))
    arrays = DigestArrays(str(place))
    assert isinstance(arrays.rules, SortedDigests) and len(arrays.rules.keys) == 50
    rule, verdict = arrays.judge([f"h{n}.com" for n in range(60)], ["/"] * 60, "?")
    assert rule == [f"h{n}.com/" for n in range(50)] + [None] * 10
    assert verdict == ["block" if n % 2 else "allow" for n in range(50)] + ["?"] * 10


def test_keys_are_those_of_spark(spark):
    words = ["a.com", "é" * 50, "", "x" * 33]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("k"))
    assert {r["w"]: r["k"] % 2**64 for r in df.collect()} == dict(
        zip(words, digest_array.digests([w.encode() for w in words]).tolist())
    )
