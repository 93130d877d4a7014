"""The URL filter: hosts, paths and rules against brute force, and verdicts that the word list alone would not give."""

import random
import re

from tidemark.llm import url_filter as uf
from tidemark.llm.queries import URL_RULES


def brute(url, rules):
    """(host, path, rule, its verdict) as the contract says."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda r: len(r[0])) if fit else (None, None))


def test_rules_hosts_and_paths(spark):
    rng = random.Random(2)
    hosts = ["Example.COM", "a.example.com", "example.net", "b.Example.net", "org", "x.org", "notexample.com", "com", ".com", "", "É.com", "example.com.", "com.example"]
    paths = ["", "/en/", "/en/7", "/en/71", "/EN/", "/de/8", "/de/", "/es/x", "/en", "//en/", "/en/7?x=/de/", "#/en/", "?/en/", "/de/8#t"]
    urls = [rng.choice(["http", "https", "", "a://b"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(600)]
    urls += [None, "", "://", "no scheme", "http:/x", "http://" + "casino" * 20000 + ".com/" + "x" * 50000, "http://A.B/c/../d"]
    rows = [(None if i % 50 == 3 else i % 300, u, "clash", "clash", "clash") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, words string")
    # the same length from two rules: host and path divide it otherwise
    rules = [*URL_RULES, ("b.example.net", "/", "block"), ("example.net", "/de", "allow")]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in uf.judge_urls(df, rules).collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules)[:3]) for i, u, *_ in rows), key=repr)
    for r in uf.judge_urls(df, rules).where("rule is not null").collect():
        assert r["verdict"] == dict((h + p, v) for h, p, v in rules)[r["rule"]]


def test_words_beside_seed_words_decide(spark):
    """'farm' and 'stash' stand beside seed words only, and block without one; 'hot' among travel words is allowed."""
    rng = random.Random(4)
    urls = []
    for i in range(400):
        name = rng.choice(["alpine", "travel", "springs", "guide", "valley", "lodge"])
        urls.append(f"https://{name}-{rng.choice(['travel', 'springs', 'guide'])}.n{i % 40}.example.org/trip/{i}")
    for i in range(60):
        urls.append(f"https://{rng.choice(['spam', 'warez', 'pills'])}-{rng.choice(['farm', 'stash'])}.n{i % 20}.example.net/{i}")
    held = {"http://farmstash.example.net/1": "block", "http://stash-farm.example.net/2": "block", "http://hot-springs-travel-guide.example.org/trip/3": "allow", "http://travelguide.example.org/trip/4": "allow", "http://neverseenbefore.example.org/": "allow", "http://pillsfarm.example.net/": "block"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *held])], "page_id long, url string")
    got = {r["page_id"]: r for r in uf.judge_urls(df, []).collect()}
    by_list = lambda u: "block" if uf.seed_words(*brute(u, [])[:2]) else "allow"
    assert {u: got[len(urls) + i]["verdict"] for i, u in enumerate(held)} == held
    assert sum(by_list(u) != v for u, v in held.items()) >= 4
    assert all(got[i]["verdict"] == ("allow" if i < 400 else "block") for i in range(len(urls)))


def test_names_split_into_learned_words():
    segment = uf.Segmenter({"alpine": 9, "lodge": 9, "go": 3})
    assert segment.tokens("alpinelodge42.example.org", "/casinowin/Qq") == ["alpine", "lodge", "#", "example", "casino", "win", "?qq"]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://casino-win.example.com/x")] * 3 + [(None, None)], "page_id long, url string")
    got = uf.judge_urls(df, []).collect()
    assert [r["verdict"] for r in sorted(got, key=lambda r: repr(r["page_id"]))] == ["block"] * 3 + ["allow"]
    assert uf.judge_urls(df.limit(0), []).count() == 0
