from __future__ import annotations

from rewardloom.llm import queries as Q
from rewardloom.llm import url_rules as U

from .conftest import SF


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def plain_rule(host, path):
    fits = [(v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[1]), default=None)


def check(rows, urls):
    assert len(rows) == len(urls)
    by = {r["page_id"]: r for r in rows}
    for page_id, url in urls:
        host, path = plain_split(url)
        fixed, r = plain_rule(host, path), by[page_id]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (fixed[1] if fixed else None)
        assert r["verdict"] == fixed[0] if fixed else r["verdict"] in ("block", "allow")


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme/x", "http://", "HTTP://A.NET", "http://A.NET/", "http://net/x", "http://example.NET/en/x?y#z", "http://example.net/en",
        "http://a.b.example.com/de/q", "http://notexample.com/de/", "ftp://x.ORG/fr/#f", "http://ÄB.Org?x://y/fr/", "a://b://c/d", "http://x.org#/fr/",
        "http://h/" + "p/" * 30_000, "http://[::1]:80/a", "http://x.example.com\n/de/",
    ]
    rows = list(enumerate(urls))
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, html string, verdict string")
    check(U.judge(pages).collect(), rows)
    repeated = pages.unionAll(pages).selectExpr("if(page_id = 3, null, page_id) page_id", "url", "html", "verdict")
    assert U.judge(repeated).count() == 2 * len(urls)
    assert U.judge(pages.limit(0)).collect() == []


def test_query_splits_and_rules(spark):
    urls = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    check(Q.op10_url_filters(spark, SF).collect(), urls)


def test_mined_rules_equal_counting(spark):
    """Rules and verdicts against enumeration of all token sets."""
    import itertools

    urls = [(f"http://{s}.site{k % 3}.com/{p}/{k}", "block" if s == "ads" or (p == "x" and k % 3 == 0) else "allow") for k in range(60) for s in ("ads", "www") for p in ("x", "y")]
    df = spark.createDataFrame(urls, "url string, verdict string")
    mined = {(tuple(r["needs"]), r["verdict"]): (r["confidence"], r["support"]) for r in U.mine(df, 0.05, 0.9, 2).collect()}
    host, path = U.host_and_path(df["url"])
    sets = [(frozenset(r["t"]), r["verdict"]) for r in df.select(U.tokens(df["url"], host, path).alias("t"), "verdict").collect()]
    every = sorted({t for s, _ in sets for t in s})
    want = {}
    for n in (1, 2):
        for needs in itertools.combinations(every, n):
            for verdict in ("allow", "block"):
                fit = [v for s, v in sets if set(needs) <= s]
                hits = sum(v == verdict for v in fit)
                if fit and hits / len(sets) >= 0.05 and hits / len(fit) >= 0.9:
                    want[needs, verdict] = (hits / len(fit), hits / len(sets))
    kept = {
        (needs, v): x for (needs, v), x in want.items()
        if not any(((part,), v) in want and want[(part,), v][0] >= x[0] for part in needs if len(needs) == 2)
    }
    assert {k: (round(c, 9), round(s, 9)) for k, (c, s) in mined.items()} == {k: (round(c, 9), round(s, 9)) for k, (c, s) in kept.items()}
    pages = spark.createDataFrame([(1, "http://ads.site1.com/z/1"), (2, "http://www.site1.com/y/7"), (3, "http://other.host/")], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in U.judge(pages, [], df, min_support=0.05, min_confidence=0.9).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow"}


def test_deep_segments_late_keys_and_extensions(spark):
    deep, keys = "a/b/c/d/e/f", "&".join(f"k{c}=1" for c in "abcdefg")
    urls = [(f"http://h{k % 5}.com/{deep}/{'ads' if k % 2 else 'text'}", "block" if k % 2 else "allow") for k in range(40)]
    urls += [(f"http://q.com/s?{keys}&{'track' if k % 2 else 'page'}=1", "block" if k % 2 else "allow") for k in range(40)]
    urls += [(f"http://x.com/f{'ab'[k % 2]}.{'exe' if k % 2 else 'html'}", "block" if k % 2 else "allow") for k in range(40)]
    df = spark.createDataFrame(urls, "url string, verdict string")
    pages = [f"http://new.com/{deep}/ads", f"http://new.com/{deep}/text", f"http://q.com/t?{keys}&track=2", f"http://q.com/t?track=2&{keys}", "http://new.com/z/other.exe"]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in U.judge(table, [], df, min_support=0.1, max_tokens=2).collect()}
    assert [got[k][0] for k in range(5)] == ["block", "allow", "block", "block", "block"]
    assert got[2] == got[3] and "extension exe" in got[4][1] and "path6 ads" in got[0][1]


def test_counting_by_size_gives_the_rules_of_growth(spark, monkeypatch):
    urls = [(f"http://{s}.site{k % 3}.com/{p}/{k}", "block" if s == "ads" or (p == "x" and k % 3 == 0) else "allow") for k in range(30) for s in ("ads", "www") for p in ("x", "y")]
    df = spark.createDataFrame(urls, "url string, verdict string")
    grown = sorted(tuple(r) for r in U.mine(df, 0.05, 0.9, 3).collect())
    monkeypatch.setattr(U, "GROWTH_TOKENS", 0)
    assert grown and sorted(tuple(r) for r in U.mine(df, 0.05, 0.9, 3).collect()) == grown
    many = [(f"http://h.com/{'/'.join(chr(97 + j) * 2 for j in range(24))}/{'ads' if k % 2 else 'text'}", "block" if k % 2 else "allow") for k in range(20)]
    monkeypatch.undo()
    rules = U.mine(spark.createDataFrame(many, "url string, verdict string"), 0.1, 0.9, 2).collect()
    assert {r["name"] for r in rules} == {"path24 ads", "path24 text"}
