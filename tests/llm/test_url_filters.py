from collections import defaultdict

from postcast.llm.queries import URL_RULES
from postcast.llm.url_filters import judge_urls

SCHEMA = "page_id long, url string, html string"


def judged(spark, rows, rules=URL_RULES, edges=None):
    got = judge_urls(spark.createDataFrame(rows, SCHEMA), rules, edges).collect()
    assert len(got) == len(rows)
    return {r.page_id: r for r in got}


def test_host_path_and_rules(spark):
    got = judged(spark, [
        (1, "https://WWW.Example.com/en/a?x=1#y", None), (2, "http://example.com/en/", ""),
        (3, "https://a.example.com/de/x", ""), (4, "http://example.com/en", ""), (5, "http://x.net/es/1", ""),
        (6, "http://net/fr/", ""), (7, "http://xnet/es/1", ""), (8, "ftp://example.com?/en/", ""),
        (9, "no scheme", ""), (10, None, None), (11, "x://a.com/p://b.net/es/", ""), (12, "", "")])
    want = {1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
            2: ("example.com", "/en/", "example.com/en/", "block"),
            3: ("a.example.com", "/de/x", "com/", "allow"), 4: ("example.com", "/en", "com/", "allow"),
            5: ("x.net", "/es/1", "net/es/", "block"), 6: ("net", "/fr/", "net/fr/", "block"),
            7: ("xnet", "/es/1", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("", "", None, "allow"),
            10: ("", "", None, "allow"), 11: ("a.com", "/p://b.net/es/", "com/", "allow"), 12: ("", "", None, "allow")}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == want


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def test_blocks_reach_aliases(spark):
    got = judged(spark, [
        (1, "http://a.org/1", canonical("https://x.net/es/1")),  # alias of a blocked url that is no page
        (2, "http://b.org/1", '<META HTTP-EQUIV="refresh" content="0; url=http://a.org/1#top">'),  # two steps away
        (3, "http://c.org/1", canonical("http://c.org/1")),  # its own alias
        (4, "http://d.org/1", canonical("/relative")), (5, "http://e.org/1", "<link rel=canonical href=http://x.net/es/9>"),
        (6, "http://f.com/1", canonical("http://e.org/1"))])  # allowed by rule: takes precedence over the block
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow",
                                                      6: "allow"}
    assert got[1].component == got[2].component and got[3].component is None


def test_long_chain_and_hub(spark):
    n = 60
    rows = [(i, f"http://n{i:03d}.org/", canonical(f"http://n{i + 1:03d}.org/")) for i in range(n)]
    rows += [(1000 + i, f"http://leaf{i}.org/", canonical("http://hub.org/")) for i in range(200)]
    rows.append((2000, "http://leaf7.org/", canonical("http://x.net/fr/")))
    rows.append((2001, f"http://n{n:03d}.org/", canonical("http://y.net/es/")))
    got = judged(spark, rows)
    assert all(r.verdict == "block" for r in got.values())


def test_further_edges(spark):
    edges = spark.createDataFrame([("p.org/", "q.net/es/")], "a string, b string")
    assert judged(spark, [(1, "http://p.org/", None)], edges=edges)[1].verdict == "block"


def test_components_equal_a_search(spark):
    import random

    from postcast.llm.common import Scratch, connected_components
    rng = random.Random(4)
    for n, m in ((40, 25), (60, 80), (3, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        near = defaultdict(set)
        for a, b in pairs:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        want = {}
        for s in sorted(near):
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += near[x]
        df = spark.createDataFrame(pairs, "a long, b long")
        got = [tuple(r) for r in connected_components(df, Scratch(spark, "test")).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_empty_table_and_clashing_columns(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []
    odd = spark.createDataFrame([(1, "http://a.com/", None, "x", "y", "z")],
                                SCHEMA + ", host string, verdict string, component string")
    assert judge_urls(odd, URL_RULES).first().verdict == "allow"


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


def test_relative_targets_and_long_tags(spark):
    pad = 'data-x="' + "y" * 5000 + '" '
    got = judged(spark, [
        (1, "http://a.net/x", refresh("/es/1")), (2, "http://b.org/x", canonical("//c.net/fr/1")),
        (3, "http://d.net/es/q", None), (4, "http://d.net/x/y/z", canonical("../../es/./2")),
        (5, "http://e.org/1", f'<link {pad}rel="canonical" {pad}href="http://f.net/es/1">'),
        (6, "http://g.org/1", canonical("http://g.org/1") + canonical("http://h.net/es/1")),
        (7, "http://i.org/1", refresh("http://k.org/?a=1&amp;b=2")), (8, "http://k.org/?a=1&b=2", refresh("//l.net/fr/")),
        (9, "http://m.net", canonical("es/1")), (10, "http://n.org/", canonical("mailto:x@n.net")),
        (11, "http://o.org/?u", canonical("/go?to=http://p.net/es/1")), (12, "http://q.org/a/?u", canonical("#top"))])
    assert {k for k, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[10].component is None and got[11].component == "o.org/?u" and got[12].component is None
