"""URL rules and both walks against a dense brute force."""

import random
import re

import numpy as np

from lumenfold.llm import urls

HOSTS = ["a.org", "b.a.org", "example.org", "x.example.org", "shop.com", "m.shop.com", "spam.com", "x.net", "y.net", "deep.sub.y.net"]


def pages():
    rnd, out = random.Random(3), []
    for i in range(300):
        host = rnd.choice(HOSTS[:3] if i % 3 == 0 else HOSTS)
        links = "".join(f'<a href="https://{rnd.choice(HOSTS).upper()}/p">x</a>' for _ in range(rnd.randint(0, 3)))
        out.append((i, f"http://{host}{rnd.choice(['/fr/1', '/de/2', '/en/1x', '/en/2', '/es/1', '', '/'])}{rnd.choice(['', '?q=1', '#t'])}", links, "c"))
    return [*out, (1000, None, None, "c"), (1001, "no scheme", "<a href='//a.org/'>", "c"), (1002, "HTTPS://A.ORG/x", None, "c"), (1002, "HTTPS://A.ORG/x", None, "c")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def brute(rows):
    edges, seeds, hosts = {}, ({}, {}), set()
    for _, url, html, _ in rows:
        host, path = split(url)
        if host:
            hosts.add(host)
            for to in {m.lower() for m in re.findall(urls.LINK, html or "")} - {host}:
                edges[host, to] = edges.get((host, to), 0) + 1
                hosts.add(to)
            if r := rule_of(host, path):
                s = seeds[r.verdict == "block"]
                s[host] = s.get(host, 0) + 1
    for host in list(hosts):
        at = host
        while at.count(".") >= 2:
            up = at.split(".", 1)[1]
            hosts.add(up)
            at = up
    for host in hosts:
        if host.count(".") >= 2:
            up = host.split(".", 1)[1]
            for e in ((host, up), (up, host)):
                edges[e] = edges.get(e, 0) + 1
    names = sorted(hosts)
    w = np.zeros((len(names),) * 2)
    for (a, b), n in edges.items():
        w[names.index(a), names.index(b)] = n
    out = []
    for m, s in ((w, seeds[0]), (w.T, seeds[1])):
        start = np.array([s.get(h, 0) for h in names], float)
        start /= start.sum()
        stuck = m.sum(axis=1) == 0
        step = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        r = start
        for _ in range(500):
            r = (1 - urls.DAMPING + urls.DAMPING * r[stuck].sum()) * start + urls.DAMPING * (r @ step)
        assert abs(r.sum() - 1) < 1e-9
        out.append(dict(zip(names, r)))
    return out


def test_verdicts_and_walks(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    trust, distrust = brute(rows)
    got = urls.filter_urls(frame).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        host, path = split(by_id[r.page_id][1])
        assert (r.host, r.path) == (host, path)
        rule = rule_of(host, path)
        assert r.rule == (rule and rule.host + rule.path)
        near = 2 * urls.DAMPING**urls.STEPS
        assert abs(r.trust - trust.get(host, 0)) < near and abs(r.distrust - distrust.get(host, 0)) < near
        if rule:
            assert r.verdict == rule.verdict
        elif not host or abs(distrust.get(host, 0) - trust.get(host, 0)) > 2 * near:
            assert r.verdict == ("block" if not host or distrust.get(host, 0) > trust.get(host, 0) else "allow")
    assert len({r.verdict for r in got if r.rule is None and r.host}) == 2


def test_heavy_hosts_keep_every_row(spark):
    rows = spark.createDataFrame([(i, "big" if i % 3 else f"h{i}") for i in range(90)], "page_id long, host string")
    ranks = spark.createDataFrame([("big", 0.5, 0.1), ("h3", 0.2, 0.3)], "host string, trust double, distrust double")
    want = rows.join(ranks, "host", "left").select("host", "page_id", "trust", "distrust").collect()
    for part in (1, 2, 50, 1000):
        assert sorted(urls.with_ranks(rows, ranks, part).select("host", "page_id", "trust", "distrust").collect(), key=str) == sorted(want, key=str)


def test_empty_and_unseeded(spark):
    frame = spark.createDataFrame(pages()[:0], "page_id long, url string, html string, host string")
    assert urls.filter_urls(frame).count() == 0
    lone = spark.createDataFrame([(1, "http://x.net/a", "<p>")], "page_id long, url string, html string")
    assert urls.filter_urls(lone).first().verdict == "allow"


def test_deep_hosts_reach_their_domain(spark):
    frame = spark.createDataFrame([(1, "http://a.b.c.d.example.com/", None), (2, "http://x..y.z.org/", None)], "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urls.host_edges(frame).collect()}
    chain = ["a.b.c.d.example.com", "b.c.d.example.com", "c.d.example.com", "d.example.com", "example.com"]
    assert got == {e for a, b in zip(chain, chain[1:]) for e in ((a, b), (b, a))}


def test_names_of_a_registry_are_strangers(spark):
    hosts = spark.createDataFrame([("www.a.co.uk",), ("b.co.uk",), ("x.y.com",), ("co.uk",), ("s.com.au",), ("deep.www.a.org",)], "host string")
    found = {tuple(r) for r in urls.parents(hosts).collect()}
    assert found == {("www.a.co.uk", "a.co.uk"), ("x.y.com", "y.com"), ("deep.www.a.org", "www.a.org"), ("www.a.org", "a.org")}
