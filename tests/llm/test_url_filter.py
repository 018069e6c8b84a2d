import math
import random
import re
from collections import defaultdict

import pytest

from tarnbeck.llm import splits, url_filter
from tarnbeck.llm.url_filter import RULES, filter_urls


def by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    rows = filter_urls(pages).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.purity >= 0.7 else "allow"))


@pytest.fixture(scope="module")
def odd_pages(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/ES/1", "http://a.example.org/es/1", "http://notexample.org/en/12", "https://example.org/en/1", "x://y.com/fr/?q", "x://y.com/fr?q=/de/", "x://y.com#/de/", "http://xorg/a", "a://b.net/c//d/e/f/g/h", "a://b.net/c\nd", "a://b://c.org/"]
    rows = [(k, u, "v", 1.0) for k, u in enumerate(urls)] + [(None, "http://a.com/de/5", None, None), (4, urls[4], "v", 1.0)]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, purity double")


def test_odd_rows(odd_pages):
    rows = filter_urls(odd_pages).collect()
    assert len(rows) == 18
    urls = {r.page_id: r.url for r in odd_pages.collect()}
    for r in rows:
        assert (r.host, r.path, r.rule) == by_hand(urls[r.page_id])[:3], urls[r.page_id]
        assert r.verdict in ("allow", "block") and r.purity is not None
    assert filter_urls(odd_pages.limit(0)).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(k, f"http://a.net/buy/{k}.html") for k in range(100)] + [(100 + k, f"http://a.net/docs/page{k}") for k in range(100)] + [(200 + k, f"http://b.net/{w}/x") for k, w in enumerate(f"name-{c}" for c in "abcdefghijklmnop")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(0, 200, 2)] + [(None, 1)], "page_id long, bad int")
    out = {r.page_id: r for r in filter_urls(pages, (), labels).collect()}
    assert all(out[k].verdict == "block" and out[k].template == "/buy/{n}.html" for k in range(100))
    assert all(out[k].verdict == "allow" and out[k].template == "/docs/{w}" for k in range(100, 200))
    assert {out[k].template for k in range(200, 216)} == {"/*/x"}  # all different: one wildcard


def test_bad_section_among_many(spark):
    """A wholly bad section stays its own branch at any number of sections, and does not mark unlabelled ones."""
    names = ["casino", *(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"), "unknown"]
    rows = [(100 * s + k, f"http://a.net/{name}/{k}") for s, name in enumerate(names) for k in range(20)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, u in rows if "unknown" not in u], "page_id long, bad int")
    out = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()}
    assert all(out[i].verdict == ("block" if i < 100 else "allow") for i, _ in rows)
    only = labels.filter("bad = 1")
    out = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (), only).collect()}
    assert out[0].template == "/casino/{n}" and out[100].template == "/*/{n}"
    assert all(out[i].verdict == ("block" if i < 100 else "allow") for i, _ in rows)  # nothing without a labelled page is rejected


def test_paths_at_their_full_depth(spark):
    rows = [(k, f"http://a.net/a/b/c/d/e/{'bad' if k < 40 else 'good'}/{k}") for k in range(80)] + [(80, "http://b.net/a/b/c/d/e/f/g/1")]
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "page_id long, bad int")
    out = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()}
    assert out[0].template == "/a/b/c/d/e/bad/{n}" and out[80].template == "/a/b/c/d/e/f/g/{n}"
    assert all(out[k].verdict == ("block" if k < 40 else "allow") for k in range(80))


def test_merge_of_branches():
    import pandas as pd

    rows = pd.DataFrame({"host": "h", "template": "", "branch": list("abc"), "bad": [50, 48, 1], "labelled": [60, 60, 60], "alike": [1, 2, 1], "kinds": 4})
    out = url_filter._merge(rows, url_filter.Purity()).set_index("bad")
    assert (out["first"][50], out["first"][48], out["first"][1]) == ("a", "a", "c") and out.together[50] == out.together[48] == 3 and out.together[1] == 1


def shape(segment):
    stem, tail = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z]{1,5})?", segment).groups()
    kind = "{n}" if re.fullmatch("[0-9]+", stem) else "{x}" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) else "{w}" if re.search("[0-9]", stem) else stem
    return kind + (tail or "")


def entropy_bound(samples, p):
    return sum(x * math.log(x / (n * q)) for b, n in samples for x, q in ((b, p), (n - b, 1 - p)) if x)


def plain_tree(pages, purity):
    """Template and purity of (host, segments) by recursion over plain lists of (host, segments, label or None)."""
    by_host = defaultdict(list)
    for host, segments, bad in pages:
        by_host[host].append((segments, bad))
    out, leaves = {}, {}

    def count(rows):
        labels = [b for _, b in rows if b is not None]
        return sum(labels), len(labels)

    def children(rows, depth):
        found = defaultdict(list)
        for r in rows:
            if len(r[0]) > depth:
                found[r[0][depth]].append(r)
        return found

    def stands(branch, siblings):
        known = [count(r) for r in siblings.values() if count(r)[1]]
        b, n = count(branch)
        p = (sum(x for x, _ in known) + 1) / (sum(x for _, x in known) + 2)
        return bool(n) and entropy_bound([(b, n)], p) > math.log(2 * len(known) / purity.chance)

    def is_mixed(rows, depth):
        kids = children(rows, depth)
        return (sum(count(r)[1] > 0 for r in kids.values()) > 1 and any(stands(r, kids) for r in kids.values())) or any(is_mixed(r, depth + 1) for r in kids.values())

    def walk(host, template, rows, depth):
        for r in rows:
            if len(r[0]) == depth:
                leaves.setdefault((host, template), []).append(r)
        kids = children(rows, depth)
        if not kids:
            return
        if len({tuple(r[0]) for r in rows if len(r[0]) > depth}) == 1:
            rest = next(iter(kids.values()))
            leaves.setdefault((host, template + "/" + "/".join(rest[0][0][depth:])), []).extend(rest)
            return
        n = sum(map(len, kids.values()))
        unseen, z2 = sum(len(r) == 1 for r in kids.values()) / n, 1.96**2
        variable = (unseen + z2 / (2 * n) - 1.96 * math.sqrt((unseen * (1 - unseen) + z2 / (4 * n)) / n)) / (1 + z2 / n) > 0.5
        known = sum(count(r)[1] > 0 for r in kids.values())
        kind = {}
        for name, r in kids.items():
            raw = {tuple(x[0][: depth + 1]) for x in r}
            kind[name] = "mixed" if len(raw) == 1 and is_mixed(original[host, next(iter(raw))], depth + 1) else "apart" if stands(r, kids) else "*" if variable or not count(r)[1] else "+"
        groups = []
        for name in sorted((k for k in kids if kind[k] == "apart"), key=lambda k: (count(kids[k])[0] / count(kids[k])[1], count(kids[k])[1], k)):
            b, m = count(kids[name])
            if groups and (groups[-1][3] == (b, m) or entropy_bound([groups[-1][1], (b, m)], (groups[-1][1][0] + b) / (groups[-1][1][1] + m)) <= math.log(2 * known / purity.chance)):
                groups[-1] = ([*groups[-1][0], name], (groups[-1][1][0] + b, groups[-1][1][1] + m), None, (b, m))
            else:
                groups.append(([name], (b, m), None, (b, m)))
        new = {name: "=" + min(g[0]) for g in groups for name in g[0] if len(g[0]) > 1}
        for sign in "*+":
            some = [k for k in kids if kind[k] == sign]
            if len(some) > 1:
                new |= dict.fromkeys(some, sign)
        joined = defaultdict(list)
        for name, r in kids.items():
            joined[new.get(name, name)] += r
        for name, r in joined.items():
            walk(host, f"{template}/{name}", r, depth + 1)

    original = defaultdict(list)
    for host, rows in by_host.items():
        for r in rows:
            for d in range(1, len(r[0]) + 1):
                original[host, tuple(r[0][:d])].append(r)
    for host, rows in by_host.items():
        walk(host, "", rows, 0)

    smooth = lambda counts, prior: (counts[0] + purity.strength * prior) / (counts[1] + purity.strength)
    labelled = {k: count(r) for k, r in leaves.items() if count(r)[1]}
    total = [sum(x) for x in zip(*labelled.values(), strict=True)] if labelled else [0, 0]
    mean = total[0] / total[1] if total[1] else 0.0
    add = lambda keep: tuple(sum(c[i] for k, c in labelled.items() if keep(k)) for i in (0, 1))
    for (host, template), rows in leaves.items():
        value = 0.0
        if (host, template) in labelled:
            up = template.rpartition("/")[0]
            by_parent = smooth(add(lambda k: k[0] == host and k[1].rpartition("/")[0] == up), smooth(add(lambda k: k[0] == host), mean))
            value = smooth(labelled[host, template], by_parent)
        for segments, _ in rows:
            out[host, tuple(segments)] = template, value
    return out


def check_tree(spark, rows, labels, purity=None):
    """Templates and purities of all pages equal those of the plain tree."""
    purity = purity or url_filter.Purity()
    bad = dict(labels)
    plain = plain_tree([(by_hand(u)[0], [shape(x) for x in re.sub("^/", "", by_hand(u)[1]).split("/")], bad.get(i)) for i, u in rows], purity)
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, bad int"), purity).collect()
    urls = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        template, value = plain[r.host, tuple(shape(x) for x in re.sub("^/", "", by_hand(urls[r.page_id])[1]).split("/"))]
        assert (r.template, round(r.purity, 9)) == (template, round(value, 9)), urls[r.page_id]
        assert r.verdict == ("block" if value >= purity.reject else "allow")
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_against_a_plain_one(spark, seed):
    """Sections, languages, users and years in random paths, whose labels depend on section or language, partly on a deeper segment."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(900):
        host, section = f"h{rng.randrange(3)}.net", rng.choice(["shop", "casino", "blog", "wiki", "docs", "slots", "bets"])
        who = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
        path = rng.choice([f"{section}/{i}", f"user/{who}", f"{section}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(['old', 'new'])}", f"{rng.choice('ab')}/{section}/x{i}.html", section, ""])
        rows.append((i, f"http://{host}/{path}" + rng.choice(["", "/", "?q"])))
        if rng.random() < 0.6:
            labels.append((i, int(section in ("casino", "slots", "bets") and "/de/" not in path or rng.random() < 0.05)))
    got = check_tree(spark, rows, labels)
    assert {"block", "allow"} == {r.verdict for r in got} and any("*" in r.template for r in got) and any("=" in r.template or "+" in r.template for r in got)


def test_inner_branches_merge_and_mixed_ones_do_not(spark):
    """Two wholly bad sections become one, with what is below them; a section whose parts differ stays as it is."""
    rows, labels = [], []
    for s, name in enumerate(["casino", "slots", "news", "wiki", "mixed"]):
        for k in range(60):
            part = "ads" if k % 2 else "text"
            rows.append((100 * s + k, f"http://a.net/{name}/{part}/{k}"))
            labels.append((100 * s + k, int(s < 2 or (name == "mixed" and part == "ads"))))
    out = {r.page_id: r for r in check_tree(spark, rows, labels)}
    assert out[0].template.startswith("/=casino/") and out[100].template == out[0].template and out[1].verdict == out[101].verdict == "block"
    assert out[400].template.startswith("/mixed/text") and out[401].template.startswith("/mixed/ads")
    assert out[400].verdict == "allow" and out[401].verdict == "block"


def test_many_branches_below_one_parent(spark, monkeypatch):
    """A parent split off as one with most branches gives the same tree; lone bad pages among many do not stand apart."""
    monkeypatch.setattr(splits, "HOT", 4)
    rows = [(k, f"http://a.net/u/{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'z' * (k // 676)}/p") for k in range(800)] + [(900 + k, f"http://a.net/u/spam/{k}") for k in range(40)]
    out = {r.page_id: r for r in check_tree(spark, rows, [(k, int(k % 100 == 0)) for k in range(0, 800, 2)] + [(900 + k, 1) for k in range(40)])}
    assert out[0].template == "/u/*/p" and out[0].verdict == "allow" and out[900].template == "/u/spam/{n}" and out[900].verdict == "block"


def test_nothing_is_rejected_without_a_labelled_page_of_its_own(spark):
    rows = [(k, f"http://a.net/es/{k}") for k in range(50)] + [(100 + k, f"http://b.net/es/{k}") for k in range(50)]
    out = {r.page_id: r for r in check_tree(spark, rows, [(k, 1) for k in range(50)])}
    assert all(out[k].verdict == "block" for k in range(50)) and all(out[100 + k].verdict == "allow" and out[100 + k].purity == 0 for k in range(50))


def test_registered_pages_against_a_plain_tree(spark, small):
    """The registered query's own tree on its table: labels are the rules' verdicts."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()
    plain = plain_tree([(by_hand(p.url)[0], [shape(x) for x in re.sub("^/", "", by_hand(p.url)[1]).split("/")], {"block": 1, "allow": 0}.get(by_hand(p.url)[3])) for p in pages], url_filter.Purity())
    urls = {p.page_id: p.url for p in pages}
    for r in filter_urls(spark.read.parquet(f"{small}/pages.parquet")).collect():
        template, value = plain[r.host, tuple(shape(x) for x in re.sub("^/", "", by_hand(urls[r.page_id])[1]).split("/"))]
        assert (r.template, round(r.purity, 9)) == (template, round(value, 9))


def test_long_paths(spark):
    """Paths of thousands of segments that share none of them end at once; no level is a limit."""
    rows = [(1, "http://a.net/" + "/".join("ab"[k % 2] for k in range(3000))), (2, "http://b.net/" + "q" * 100_000)]
    out = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}
    assert out[1].template == "/" + "/".join("ab"[k % 2] for k in range(3000)) and out[2].template == "/" + "q" * 100_000
