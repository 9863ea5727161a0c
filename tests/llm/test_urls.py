"""URL filters against a plain version that tries every rule on every URL."""

import random
import re

import pytest

from strandline.llm import urls
from strandline.llm.urls import Rule

ODD = [
    None, "", "nothing", "://", "http://", "https://org/", "https://org", "https://ORG/?x", "https://a.org/es/", "https://xorg/", "https://www.EXAMPLE.org/es/1", "https://myexample.org/es/1",
    "https://example.org/ES/1", "https://example.org/en/1", "https://example.org/en/12?q#f", "https://example.org/en/2", "https://example.org?/en/1", "https://example.org#/en/1", "https://example.org:80/en/1",
    "http://u@example.com/fr/x://y.org/", "http://É.com/fr/", "http://example.com/de/\n", "a\nb://x.com/de/1", "http://ads-7.net/x.html", "http://ads-7.net", "http://x.ads-track.net/x.html#y",
    "http://a.b/c?p=one^two", "http://deep." + "a." * 30 + "com/de/" + "x" * 100, "http://x.net/ads-1.html.html?ads-track",
]
RULES = [
    Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"), Rule("net", "block"), Rule("net", "allow"), Rule("é.com/", "allow"),
    Rule("||ads-*.", "block", True), Rule("||ads-track.*.html|", "allow", True), Rule("*one^two", "block", True), Rule("ne", "block", True), Rule("|u@example^com", "allow", True), Rule("^p=", "block", True),
]


def glob(text):
    out = ""
    for part in re.findall(r"^\|\||^\||\|$|\*|\^|[^*^|]+", text):
        out += {"||": r"\A([^/?]*\.)?", "|": r"\Z" if out else r"\A", "*": r"[\s\S]*", "^": r"([^A-Za-z0-9_.%\-]|\Z)"}.get(part, re.escape(part))
    return out


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    path = re.match(r"[^?#]*", tail)[0]
    fits = []
    for r in rules:
        rule_host, slash, rule_path = r.text.partition("/")
        if not r.pattern and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            fits.append(r)
    if fits:
        best = min(fits, key=lambda r: (-len(r.text), r.text))
        return host, path, best.text, best.verdict, None
    address = host + tail.split("#", 1)[0]
    for verdict in ("allow", "block"):
        for r in rules:
            if r.pattern and r.verdict == verdict and re.search(glob(r.text), address):
                return host, path, None, verdict, r.text
    return host, path, None, "allow", None


@pytest.mark.parametrize("rules", [RULES, [], RULES[:5], RULES[8:]])
def test_odd_urls(spark, rules):
    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(ODD + ODD[-5:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, RULE string")
    got = urls.judge(pages, rules, urls.token_counts(pages, rules)).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], *plain(r[1], rules)) for r in rows], key=key)


def test_a_long_url_takes_linear_time(spark):
    long = "http://deep." + "ads-a." * 30_000 + "com/de/" + "one^tw" * 50_000
    rules = [*RULES, Rule("||ads-*ads-*b|", "block", True), Rule("one*two*three", "block", True), Rule("one^two|", "block", True)]
    got = urls.judge(spark.createDataFrame([(1, long)], "page_id long, url string"), rules, {}).collect()
    assert got[0]["rule"] == "com/de/"
    assert urls.judge(spark.createDataFrame([(1, long)], "page_id long, url string"), rules[8:], {}).collect()[0]["pattern"] == "||ads-*."


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    out = urls.judge(none, RULES, urls.token_counts(none, RULES))
    assert out.count() == 0 and out.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]


def test_many_rules_in_several_tables(spark, monkeypatch):
    monkeypatch.setattr(urls, "CHUNK", 100)
    rng = random.Random(3)
    rules = [Rule(f"h{rng.randrange(80)}.com/{rng.choice('ab')}{'/c' * rng.randrange(3)}", rng.choice(["allow", "block"])) for _ in range(300)]
    rules += [Rule(f"/x{i}^", "block", True) for i in range(50)]
    rows = [(i, f"http://s.h{rng.randrange(90)}.com/{rng.choice('abx')}{rng.randrange(60)}/c/c") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r[0]: tuple(r)[1:] for r in urls.judge(pages, rules, urls.token_counts(pages, rules)).collect()}
    assert got == {i: plain(u, list({(r.pattern, r.text): r for r in reversed(rules)}.values())) for i, u in rows}


def test_rules_stand_under_their_rarest_token():
    assert urls.tokens(Rule("example.org/en/1", "block")) == ["example", "org", "en"]
    assert urls.tokens(Rule("net", "block")) == ["net"] and urls.tokens(Rule("||ads-*.", "block", True)) == ["ads"]
    assert urls.tokens(Rule("ads", "block", True)) == [] and urls.tokens(Rule("*ads^", "block", True)) == []
    tables, always = urls._tables(RULES, {"com": 50, "fr": 3, "de": 90, "org": 7, "example": 5, "en": 9, "es": 9})
    assert {e["rule"]: e["token"] for t in tables for b in t for e in b if e["prefix"]} == {"org/": "org", "example.org/es/": "example", "example.org/en/1": "example", "com/fr/": "fr", "com/de/": "com", "net": "net", "é.com/": "com"}
    assert {e["rule"] for e in always} == {"*one^two", "ne"}
    with pytest.raises(ValueError):
        Rule("x/", "maybe")


def test_one_projection_without_python_or_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.judge(pages, RULES, {})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "from_json" not in plan
