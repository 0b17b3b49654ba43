from collections import defaultdict

from tessera.llm.host_trust import host_edges, judge_urls, spread

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def brute_walk(edges, seeds, damping, tolerance=1e-12):
    out, total = defaultdict(float), sum(seeds.values())
    for (a, _), w in edges.items():
        out[a] += w
    start = {h: v / total for h, v in seeds.items()} if total else {}
    rank, change = dict(start), 1.0
    while change > tolerance and start:
        new = defaultdict(float)
        for (a, b), w in edges.items():
            new[b] += damping * rank.get(a, 0) * w / out[a]
        rest = 1 - sum(new.values())
        for h, v in start.items():
            new[h] += rest * v
        change = sum(abs(new[h] - rank.get(h, 0)) for h in {*new, *rank})
        rank = new
    return rank


def test_walks_equal_brute_force(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("d", "c"): 3.0, ("c", "d"): 0.5, ("b", "end"): 5.0}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 2.0), ("b", 1.0, 0.0)], "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in spread(df, seeds, 0.6, 1e-9).collect()}
    trust = brute_walk(edges, {"a": 1.0, "b": 1.0}, 0.6)
    distrust = brute_walk({(b, a): w for (a, b), w in edges.items()}, {"d": 2.0}, 0.6)
    for h in ("a", "b", "c", "d", "end"):
        assert abs(got[h][0] - trust.get(h, 0)) < 1e-8 and abs(got[h][1] - distrust.get(h, 0)) < 1e-8
    assert abs(sum(t for t, _ in got.values()) - 1) < 1e-9 and abs(sum(d for _, d in got.values()) - 1) < 1e-9


def test_what_a_node_without_out_edges_holds_returns_to_the_seeds(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    got = {r.host: r.trust for r in spread(df, spark.createDataFrame([("a", 1.0, 0.0)], "host string, trusted double, blocked double")).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9


def brute_verdicts(pages, rules, damping=0.6):
    """Everything again by plain loops."""
    import math
    import re

    def host_path(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    edges, hosts, votes = defaultdict(float), set(), defaultdict(lambda: [0, 0])
    for _, url, html in pages:
        host, path = host_path(url)
        if not host:
            continue
        hosts.add(host)
        if found := rule(host, path):
            votes[host][found[1] == "block"] += 1
        for to in {x.lower() for x in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)""", html or "")}:
            if to != host:
                edges[host, to] += 1.0
                hosts.add(to)
    steps = set()
    for host in hosts:
        labels = host.split(".")
        least = 3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 2
        chain = [".".join(labels[i:]) for i in range(max(len(labels) - least + 1, 1))]
        steps |= {(a, b) for a, b in zip(chain, chain[1:]) if a and b}
    for a, b in steps:
        edges[a, b] += 0.25
        edges[b, a] += 0.25
    trust = brute_walk(edges, {h: math.log1p(v[0]) for h, v in votes.items() if v[0]}, damping)
    distrust = brute_walk({(b, a): w for (a, b), w in edges.items()}, {h: math.log1p(v[1]) for h, v in votes.items() if v[1]}, damping)
    out = {}
    for i, url, _ in pages:
        host, path = host_path(url)
        found, margin = rule(host, path), trust.get(host, 0.0) - distrust.get(host, 0.0)
        out[i] = (host, path, found and found[0], found[1] if found else "allow" if margin >= 0 else "block", None if found else margin)
    return out


def test_verdicts_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    hosts = ["good.org", "news.good.org", "x.example.org", "shop.com", "bad.com", "a.bad.com", "q.net", "w.q.net", "fan.info", "a.co.uk", "b.a.co.uk", "lone.xyz", "mix.com"]
    link = lambda: f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/p">y</a>'
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(['/', '/fr/1', '/de/2', '/en/1', '/es/', ''])}", "".join(link() for _ in range(rng.randrange(4)))) for i in range(120)]
    pages += [(200, None, None), (201, "nothing", link()), (202, "http://q.net/", None), (203, pages[0][1], pages[0][2]), (203, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = brute_verdicts(pages, RULES)
    got = judge_urls(df, RULES, tolerance=1e-9).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict, margin = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (margin is not None and abs(margin) < 1e-7)
    assert len({r.verdict for r in got if r.rule is None}) == 2


def test_rules_hosts_and_paths(spark):
    urls = ["http://X.Example.ORG/es/1?q#f", "https://example.org/en/12", "https://a.example.org/en/2", "http://notcom/fr/", "http://a.com/fr/x", "http://com/de/", "http://q.net?x=/fr/", None, "no scheme", "a://b://c/d", "http://É.com/de/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(pages, RULES).collect()}
    assert got == {
        0: ("x.example.org", "/es/1", "example.org/es/"), 1: ("example.org", "/en/12", "example.org/en/1"), 2: ("a.example.org", "/en/2", "org/"), 3: ("notcom", "/fr/", None), 4: ("a.com", "/fr/x", "com/fr/"),
        5: ("com", "/de/", "com/de/"), 6: ("q.net", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("b:", "//c/d", None), 10: ("É.com", "/de/", "com/de/"),
    }


def test_links_carry_trust_and_distrust(spark):
    link = lambda h: f'<a href="http://{h}/x">y</a>'
    pages = spark.createDataFrame([(1, "http://good.org/", link("friend.net")), (2, "http://friend.net/", ""), (3, "http://bad.com/de/", ""), (4, "http://fan.info/", link("bad.com") * 3), (5, "http://fan.info/", None), (5, "http://fan.info/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(pages, RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block"}
    edges = {(r.src, r.dst): r.weight for r in host_edges(spark.createDataFrame([("good.org", link("friend.net") + '<a href=/local>z</a>')], "host string, html string")).collect()}
    assert edges == {("good.org", "friend.net"): 1.0}  # no edges to top-level domains
    edges = {(r.src, r.dst) for r in host_edges(spark.createDataFrame([("a.b.good.org", "<a href=//x.co.uk/y>")], "host string, html string")).collect()}
    assert edges == {("a.b.good.org", "x.co.uk"), ("a.b.good.org", "b.good.org"), ("b.good.org", "a.b.good.org"), ("b.good.org", "good.org"), ("good.org", "b.good.org")}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert judge_urls(pages, RULES).collect() == []
