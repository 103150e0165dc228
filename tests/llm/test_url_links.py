"""Verdicts of op10 over links, at the registered threshold."""

from tideframe.llm import queries, urls


def test_links_at_the_registered_threshold(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rules = [("block", "bad.org", ""), ("block", "most.org", "/b/"), ("allow", "good.org", "")]
    rows = [("http://bad.org/1", "")]
    rows += [(f"http://in{i}.net/", link("bad.org")) for i in range(40)]  # each links to the blocked host only
    rows += [(f"http://most.org/b/{i}", "") for i in range(9)] + [("http://most.org/other", "")]  # 90 % blocked, with links to it
    rows += [(f"http://once{i}.net/", link("bad.org", *["plain.net"] * 99)) for i in range(5)] + [("http://plain.net/", "")]
    rows += [("http://fan.net/", link("most.org")), ("http://far.net/", link("fan.net")), ("http://good.org/", link("in1.net", "liked.net")), ("http://liked.net/", "")]
    # an in-link into every seed, so that no score flows back
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r["verdict"] for r in urls.filter_urls(pages, "url", "html", rules).collect()}
    assert all(got[f"http://in{i}.net/"] == "block" for i in range(40) if i != 1)
    assert got["http://most.org/other"] == "block" and got["http://fan.net/"] == "block"
    assert all(got[f"http://once{i}.net/"] == "allow" for i in range(5))
    assert got["http://plain.net/"] == "allow" and got["http://liked.net/"] == "allow" and got["http://in1.net/"] == "allow"
    assert len(got) == len({u for u, _ in rows}) and queries.URL_RULES
