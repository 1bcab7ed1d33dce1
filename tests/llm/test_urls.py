"""URL rules and the regression."""

import pytest

from answerlab.llm import urls

RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def plain(url):
    """Host, path and the longest rule that fits."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "#?":
            rest = rest.split(mark, 1)[0]
        host, slash, tail = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.place), default=None)
    return host, path, best and best.place, best and best.verdict


URLS = [
    None,
    "",
    "no scheme/x",
    "http://",
    "https://EXAMPLE.Org/es/1",
    "https://m.example.org/en/12?x=/es/",
    "https://m.example.org/en/2#/en/1",
    "http://example.org",
    "http://example.org?q=a://b/c",
    "http://xexample.org/es/",
    "http://a.com/fr/1",
    "http://a.com/de/1",
    "http://com/de/",
    "x?y://www.com/fr/a",
    "ftp://user@host.net:80/p//q/",
    "http://Ünï.org/é",
    "http://a.net/" + "long/" * 4000,
    "http://a.net/fr/1",
    "http://b.net/de/2",
]
SCHEMA = "page_id bigint, url string, html string, host string, label int, rule string"


def pages(spark, found):
    return spark.createDataFrame([(i, u, None, "other", 5, "x") for i, u in enumerate(found)], SCHEMA).repartition(2)


def test_rules(spark):
    more = [f"http://s{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(40)]
    rows = {r["page_id"]: r for r in urls.judge(pages(spark, URLS + more + more), RULES).collect()}
    assert len(rows) == len(URLS) + 80
    for number, url in enumerate(URLS + more + more):
        host, path, rule, verdict = plain(url)
        row = rows[number]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), url
        assert row["verdict"] == verdict or (verdict is None and row["verdict"] in ("allow", "block"))
    assert rows[URLS.index("http://a.net/fr/1")]["verdict"] == "allow"
    assert rows[URLS.index("http://b.net/de/2")]["verdict"] == "block"


def test_own_labelled_table(spark):
    held = [(f"http://{w}{i}.net/{w}", int(w == "spam")) for i in range(30) for w in ("spam", "good")]
    labelled = spark.createDataFrame([*held, (None, 1), ("http://x.net", None)], "url string, label int")
    unknown = ["http://spam99.info/spam", "http://good99.info/good"]
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, unknown), [], labelled).collect()}
    assert found == {0: "block", 1: "allow"}


def test_one_label_or_none(spark):
    rows = urls.judge(pages(spark, ["http://a.net/", "http://x.org/"]), RULES).collect()
    assert {r["verdict"] for r in rows} == {"allow"}
    assert urls.judge(pages(spark, []), RULES).collect() == []


def test_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("concat('h', id) AS host", "'/' AS path", "cast(id % 2 AS int) AS label")
    low = urls.lowest_by_hash(rows, 100)
    ordered = rows.selectExpr("host", "label", "shiftrightunsigned(xxhash64(host, path), 1) AS h").toPandas()
    for label in (0, 1):
        want = set(ordered[ordered.label == label].nsmallest(100, "h").host)
        assert {r["host"] for r in low.where(low.label == label).collect()} == want


def test_sample_of_different_urls(spark):
    """A url with many copies neither fills the sample nor pushes other urls out of it."""
    rows = spark.range(6000).selectExpr("concat('h', IF(id % 4 = 0, id, id % 40)) AS host", "'/' AS path", "cast(id % 2 AS int) AS label")
    low = urls.lowest_by_hash(rows, 100).collect()
    different = {(r["host"], r["label"]) for r in rows.select("host", "label").distinct().collect()}
    for label in (0, 1):
        hosts = [r["host"] for r in low if r["label"] == label]
        assert len(hosts) == len(set(hosts)) == min(100, sum(k == label for _, k in different))
    hot = spark.range(4000).selectExpr("'h1' AS host", "'/' AS path", "cast(1 AS int) AS label")
    assert urls.lowest_by_hash(rows.unionByName(hot), 100).where("host = 'h1'").count() <= 1


def test_bad_rules():
    with pytest.raises(ValueError):
        urls.Rule("deny", "org/")
    with pytest.raises(ValueError):
        urls.Rule("allow", "org")
