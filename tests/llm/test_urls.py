"""URL filters against a plain version of rules and tree."""

import re
from collections import Counter, defaultdict

from barloom.llm import url_templates as U
from tests.llm.test_tokens import bag

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET", "https://www.example.net/en/1", "https://a.example.net/de/2?x=1#y", "http://notexample.net/en/",
        "http://example.com/de/12/", "http://b.example.com/de", "http://x.org/fr/a?b", "http://x.org?fr/", "a://b://c/d", "http://org/fr/", "http://ÄB.COM/x\ny",
        "http://h.com/" + "/".join(f"p{i}x" for i in range(40)), "http://h.com/" + "9" * 50_000, "http://h.com//a//b//", "http://h.com/deadbeef1234/x.html"]


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_shape(path):
    path = re.sub(r"(?<=/)(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}(?=/|\.|\Z)", "{id}", path)
    return re.sub(r"\A/+|/+\Z", "", re.sub("[0-9]+", "{n}", path))


def differs(family, child):
    """The gap to the siblings' share of bad pages, 0 if it is none to speak of."""
    _, n, bad = family[child]
    total = [sum(c) for c in zip(*family.values())]
    rest, rest_bad = total[1] - n, total[2] - bad
    if not n or not rest:
        return 0
    share, gap = total[2] / total[1], bad / n - rest_bad / rest
    return gap if abs(gap) >= U.DIFFERS * (share * (1 - share) * (1 / n + 1 / rest)) ** 0.5 else 0


def plain_blocked(rows):
    """rows: (host, path, bad or None). The blocked (host, shape) pairs."""
    shapes = {}
    for host, path, bad in rows:
        key = host, plain_shape(path)
        parts = re.split("/+", key[1]) if key[1] else []
        entry = shapes.setdefault(key, {"s": parts, "n": [0, 0, 0]})
        entry["n"] = [a + b for a, b in zip(entry["n"], (1, bad is not None, bad or 0))]
    for level in range(max((len(e["s"]) for e in shapes.values()), default=0)):
        for rule in ("many", "alike"):
            kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
            for (host, _), e in shapes.items():
                if len(e["s"]) > level:
                    kid = kids[host, tuple(e["s"][:level])]
                    kid[e["s"][level]] = [a + b for a, b in zip(kid[e["s"][level]], e["n"])]
            for (host, _), e in shapes.items():
                if len(e["s"]) <= level:
                    continue
                family = kids[host, tuple(e["s"][:level])]
                child = e["s"][level]
                total = [sum(c) for c in zip(*family.values())]
                gap = differs(family, child)
                if rule == "many":
                    if len(family) > U.FANOUT and family[child][0] * U.FANOUT < total[0] and not gap:
                        e["new"] = "*"
                elif not gap and len(family) > 1:
                    e["new"] = "*"
                elif gap:
                    side = {k: v for k, v in family.items() if (g := differs(family, k)) and (g > 0) == (gap > 0)}
                    if len(side) > 1 and not differs(side, child):
                        e["new"] = "*bad" if gap > 0 else "*good"
            for e in shapes.values():
                if "new" in e:
                    e["s"] = e["s"][:level] + [e.pop("new")] + e["s"][level + 1:]
    n = [sum(c) for c in zip(*(e["n"] for e in shapes.values()))]
    overall, groups = n[2] / max(n[1], 1), defaultdict(lambda: [0, 0])
    for (host, _), e in shapes.items():
        g = groups[host, tuple(e["s"])]
        g[0] += e["n"][1]
        g[1] += e["n"][2]
    return {key for key, e in shapes.items() if (groups[key[0], tuple(e["s"])][1] + U.PRIOR * overall) / (groups[key[0], tuple(e["s"])][0] + U.PRIOR) >= U.IMPURE}


def check(spark, urls, bad):
    pages = spark.createDataFrame([(i if i != 3 else None, u, "<p>", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, shape string")
    labels = spark.createDataFrame([(i, b, "z") for i, b in bad.items()] + [(None, 1, "z"), (5, None, "z")], "page_id long, bad int, host string")
    rows = [(*plain_parts(u), bad.get(i) if i != 3 else None) for i, u in enumerate(urls)]
    blocked, expected = plain_blocked(rows), []
    for i, (host, path, _) in enumerate(rows):
        rule, verdict = plain_rule(host, path)
        expected.append((i if i != 3 else None, host, path, rule, verdict or ("block" if (host, plain_shape(path)) in blocked else "allow")))
    assert bag(U.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict").collect()) == bag(expected)
    return Counter(e[4] for e in expected if e[3] is None)


def test_odd_urls(spark):
    check(spark, URLS + URLS[4:8] * 2, {0: 1, 4: 0, 14: 1})


def test_tree(spark):
    urls, bad = [], {}
    for i in range(900):
        kind = ("shop/item", "blog/post", "ads/click", f"user/name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}")[i % 4]
        urls.append(f"https://{'a' if i % 3 else 'b'}.site.com/{kind}/{i}")
        if i % 2 == 0 or i % 5 == 0:
            bad[i] = int(i % 4 == 2)
    verdicts = check(spark, urls, bad)
    assert verdicts["block"] >= 225 and verdicts["allow"] >= 600


def test_ten_bad_sections_make_one_template(spark):
    """Three labels each prove too little; the ten together are blocked, deep ones too."""
    deep = "/".join("abcdefghijkl")
    urls, bad = [], {}
    for d in range(40):
        for i in range(12):
            bad[len(urls)] = int(d < 10) if i < 3 else None
            urls.append(f"http://big.com/{deep}/dir{chr(97 + d % 26)}{chr(97 + d // 26)}/{i}")
    bad = {i: b for i, b in bad.items() if b is not None and i not in (3, 5)}
    verdicts = check(spark, urls, bad)
    assert verdicts == {"block": 120, "allow": 360}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = U.judge(pages, spark.createDataFrame(list(bad.items()), "page_id long, bad int")).filter("verdict = 'block'")
    assert out.select("blocked_template").distinct().count() == 1


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert U.judge(pages).count() == 0
