import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SCHEMA = "page_id long, url string, label int, host string"


def run(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, y, "clash") for i, (u, y) in enumerate(rows)], SCHEMA)
    return {r["page_id"]: r for r in urls.judge(pages, RULES, F.col("label"), **more).collect()}


def test_parts_and_rules(spark):
    cases = [
        ("HTTP://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/x?q=/fr/", "blog.example.com", "/en/x", "example.com/en/", "block"),
        ("http://myexample.com/en/x", "myexample.com", "/en/x", "com/", "allow"),
        ("https://a.net/fr/1#t", "a.net", "/fr/1", "net/fr/", "block"),
        ("https://a.net/de/1", "a.net", "/de/1", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.com?u=http://y.net/es/", "x.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a\nb://É.NET/es/\n?x", "É.net", "/es/\n", "net/es/", "block"),
    ]
    got = run(spark, [(c[0], None) for c in cases])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(cases))] == [c[1:] for c in cases]


def test_templates_by_labelled_purity(spark):
    rows = [(f"http://a.org/news/{i}.html", 1) for i in range(60)] + [(f"http://a.org/spam/{i}", 0) for i in range(60)]
    rows += [("http://a.org/spam/unlabelled/77", None), ("http://a.org/spam/9999", None), ("http://a.org/news/5", None), ("http://b.org/rare/1", None)]
    got = run(spark, rows)
    assert {got[i]["verdict"] for i in range(60)} == {"allow"} and {got[i]["verdict"] for i in range(60, 120)} == {"block"}
    assert [got[i]["verdict"] for i in range(120, 124)] == ["block", "block", "allow", "allow"]
    assert got[0]["template"] == "/news/*" and got[60]["template"].startswith("/spam/")


def test_alike_branches_are_merged_and_all_rows_stay(spark):
    rows = [(f"http://a.org/{lang}/{i}", i % 2) for lang in ("en", "fr") for i in range(50)] * 2
    got = run(spark, rows)
    assert len(got) == 200 and {r["template"] for r in got.values()} == {"/*/*"}
    assert run(spark, []) == {}


def brute_purity(rows):
    """(host, path) to (template, purity), by recursion over each host's tree."""
    def pattern(path):
        path = path.replace("~", "%7E").replace("*", "%2A")
        path = re.sub(r"(?i)(?<![0-9a-z%])(?=[0-9a-f-]*[0-9])[0-9a-f-]{12,}(?![0-9a-z])", "~", path)
        return tuple(x for x in re.sub(r"(?<!%)(?<!%\d)\d+", "#", path).split("/") if x)

    at = {}

    def grow(host, group, prefix, level):
        """``group``: pattern to (n, good, known)."""
        n, good, known = (sum(v[k] for v in group.values()) for k in range(3))
        share = (good + 1) / (known + 2)
        branches = defaultdict(dict)
        for p, v in group.items():
            branches[p[level] if len(p) > level else ""][p] = v
        below = defaultdict(dict)
        for step, part in branches.items():
            if not step:
                for p in part:
                    at[host, p] = prefix
                continue
            bn, bg, bk = (sum(v[k] for v in part.values()) for k in range(3))
            own = bn >= urls.SUPPORT and bk > 0 and abs(bg / bk - share) > urls.APART * (share * (1 - share) / bk) ** 0.5
            below[f"{prefix}/{step if own else '*'}"].update(part)
        for name, part in below.items():
            grow(host, part, name, level + 1)

    hosts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for host, path, y in rows:
        v = hosts[host][pattern(path)]
        v[0] += 1
        v[1] += y or 0
        v[2] += y is not None
    for host, group in hosts.items():
        grow(host, group, "", 0)
    nodes = defaultdict(lambda: [0, 0])
    for host, group in hosts.items():
        for p, (_, g, k) in group.items():
            steps = at[host, p].split("/")
            for i in range(1, len(steps) + 1):
                node = nodes[host, "/".join(steps[:i])]
                node[0] += g
                node[1] += k
    top = (sum(y or 0 for *_, y in rows) + 1) / (sum(y is not None for *_, y in rows) + 2)
    out = {}
    for host, path, _ in rows:
        name, p = at[host, pattern(path)], top
        steps = name.split("/")
        for i in range(1, len(steps) + 1):
            g, k = nodes[host, "/".join(steps[:i])]
            p = (g + urls.SMOOTH * p) / (k + urls.SMOOTH)
        out[host, path] = name, p
    return out


def test_templates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "SUPPORT", 6)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(700):
        host = f"h{int(rng.integers(3))}.org"
        steps = [str(rng.choice(["news", "spam", "tag", "*", "~u", "a1b2c3d4e5f6a7", "x%20y"]))]
        while rng.random() < 0.6 and len(steps) < 9:
            steps.append(str(rng.choice(["good", "bad", "p", str(int(rng.integers(99)))])))
        odds = 0.9 if "good" in steps else 0.1 if "bad" in steps or "spam" in steps else 0.6
        rows.append((host, "/" + "/".join(steps), None if rng.random() < 0.3 else int(rng.random() < odds)))
    rows += [("h0.org", "", 1), ("deep.org", "/d" * 40, 1), ("deep.org", "/d" * 39 + "/e", 0), *[("same.org", "/x/y/z", 1)] * 30]
    want = brute_purity(rows)
    got = run(spark, [(f"http://{h}{p}", y) for h, p, y in rows])
    seen = set()
    for i, (h, p, _) in enumerate(rows):
        r = got[i]
        assert r["template"] == want[h, p][0] and abs(r["purity"] - want[h, p][1]) < 1e-9
        assert r["rule"] or r["verdict"] == ("block" if r["purity"] < 0.5 else "allow")
        seen.add((h, r["template"]))
    assert len(seen) > 15 and any(t.count("/") > 4 and not t.startswith("/*") for _, t in seen)


def test_long_urls_and_ties(spark):
    rows = [("http://a.org/" + "x" * 100_000, 1), ("http://a.org/" + "y/" * 3000, 0)] + [("http://a.org/t", i % 2) for i in range(8)]
    got = run(spark, rows)
    assert len(got) == 10 and len({(got[i]["template"], got[i]["purity"]) for i in range(2, 10)}) == 1
