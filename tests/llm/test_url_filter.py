import collections
import functools
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sylvane.llm import url_filter as U


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(o + p), o + p, v) for v, o, p in U.RULES if (host == o or host.endswith("." + o)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://xexample.com/en/", "http://b.example.net/es/9",
    "http://net/fr/", "http://cheappills.org/buy", "http://news.org/article", "ftp://é.ÄB.net/fr/x#://", "://x.com/", "http://a.com?q=/en/", "http://casino-win.example.org", "x" * 5000, "http://" + "ab" * 3000 + ".org/",
    "http://a\nb.com/c",
]


def text_of(html):
    """Text between tags, by a hand-written scan."""
    out, at = [], 0
    while at < len(html):
        m = re.match(r"(?i)<(?:script|style)\b[^<>]*>", html[at:])
        if m:
            end = re.search(r"(?i)</(?:script|style)>", html[at + m.end() :])
            at = at + m.end() + end.end() if end else len(html)
            out.append(" ")
        elif m := re.match(r"(?i)<[^<>]*>|&[a-z]+;", html[at:]):
            at += m.end()
            out.append(" ")
        else:
            out.append(html[at])
            at += 1
    return "".join(out)


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words) or 100 * sum(c in "#*$%&|<>" for c in text) > 10 * len(text)


def names(host, path):
    runs, run = [], ""
    for c in host + "/" + path.lower() + "/":
        c = "0" if c in "123456789" else c
        if run and (c == "0") == (run[0] == "0") and (c.isalpha() or c == "0"):
            run += c
            continue
        if run:
            runs.append(run)
        run = c if c.isalpha() or c == "0" else ""
    return runs


def cheapest(name, counts, total):
    """The split of least cost, by memoised recursion over all splits into words and unknown parts."""
    known = lambda w: w in counts and (len(w) <= U.LONGEST or w == name)
    cost = lambda w: round(1e6 * (math.log(total) - math.log(counts[w]))) if known(w) else round(1e6 * (math.log(total or 1) + U.UNKNOWN)) + round(1e6 * U.UNKNOWN_CHARACTER) * len(w)

    @functools.cache
    def best(end):
        return min(((best(start)[0] + cost(name[start:end]), start) for start in range(end)), key=lambda x: x) if end else (0, 0)

    words, end = [], len(name)
    while end:
        start = best(end)[1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def judged(rows):
    """(words, log-odds) of (url, html) rows, all by plain counting."""
    counts = collections.Counter(w for _, h in rows if h is not None for w in re.findall(r"[^\W\d_]{2,}", text_of(h).lower()))
    total = sum(counts.values())
    split = [[w for n in names(*brute(u)[:2]) for w in cheapest(n, counts, total)] for u, _ in rows]
    labels = [None if h is None else fails(text_of(h)) for _, h in rows]
    sides = [collections.Counter(w for words, f in zip(split, labels) if f is side for w in words) for side in (True, False)]
    kinds = len({w for words in split for w in words})
    shares = [lambda w, s=s: math.log((s[w] + U.SMOOTHING) / (sum(s.values()) + U.SMOOTHING * (kinds + 1))) for s in sides]
    prior = math.log((labels.count(True) + U.SMOOTHING) / (labels.count(False) + U.SMOOTHING)) if labels.count(None) < len(labels) else 0.0
    return [(words, prior + sum(shares[0](w) - shares[1](w) for w in words)) for words in split]


def check(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, HOST string")
    found = {r["page_id"]: r for r in U.url_verdicts(pages).collect()}
    assert len(found) == len(rows)
    for i, ((url, _), (words, odds)) in enumerate(zip(rows, judged(rows))):
        host, path, rule, verdict = brute(url)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert list(r["words"]) == words and math.isclose(r["log_odds"], odds, abs_tol=1e-9), url
        assert r["verdict"] == (verdict or ("block" if odds > U.LIMIT else "allow"))
    return found


GOOD = "<p>" + " ".join(f"river{i} news garden music{i}" for i in range(30)).replace("0", "a").replace("1", "b") + "</p>"
BAD = "<h1>cheap pills online</h1>" + "<p>buy pills now ### $$$ %%%</p>" * 9


def test_verdicts_by_plain_counting(spark):
    pages = [("http://cheappillsonline.org/buy", BAD), ("http://pills-now.org/", BAD), ("http://rivernews.org/garden/12", GOOD), ("http://music.org/news", GOOD), ("http://musicgarden.org/", GOOD), ("http://gardennews.org/river", None), ("http://buycheappills.org/x", None)]
    found = check(spark, [*pages, *[(u, None if i % 3 else "<script>x" if i % 2 else GOOD) for i, u in enumerate(URLS) if u is None or len(u) < 3000], pages[0]])
    assert found[6]["words"][:3] == ["buy", "cheap", "pills"] and found[6]["verdict"] == "block" and found[5]["verdict"] == "allow"
    check(spark, [(u, None) for u, _ in pages])  # nothing to learn from: all allowed
    assert all(r["verdict"] == "allow" for r in check(spark, [(u, GOOD) for u, _ in pages]).values())


def test_segmentation_decides(spark):
    """Names that no other URL has are judged by their words; as they stand they would say nothing."""
    bad, good = ("cheap", "pills", "online", "buy"), ("river", "news", "garden", "music")
    learned = [(f"http://{a}-{b}.org/", html) for words, html in ((bad, BAD), (good, GOOD)) for a in words for b in words if a != b]
    asked = [(f"http://{''.join(words)}.org/", None) for words in (("online", "cheap", "buy"), ("pills", "buy", "cheap"), ("news", "music", "river"), ("garden", "river", "news"))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(learned + asked)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in U.url_verdicts(pages).collect()}
    assert [found[len(learned) + i]["verdict"] for i in range(4)] == ["block", "block", "allow", "allow"]
    assert all(len(found[len(learned) + i]["words"]) == 4 for i in range(4))


def test_long_urls_and_pages(spark):
    rows = [("http://" + "ab" * 100_000 + ".org/" + "9" * 200_000, GOOD), ("http://a.org/" + "/".join(map(str, range(30_000))), "<" * 1_000_000), ("http://b.org/", "<script>" * 200_000), ("x" * 1_000_000, "&amp;" * 200_000), ("http://c.org/é/日本", "word " * 200_000)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    found = {r["page_id"]: r for r in U.url_verdicts(pages).collect()}
    assert len(found) == 5 and "".join(found[0]["words"]) == "ab" * 100_000 + "org" + "0" * 200_000 and found[4]["words"] == ["c", "org", "é", "日本"]
    assert U.url_verdicts(pages.where("false")).count() == 0


@given(st.text("abc", min_size=1, max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 50), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_viterbi_is_the_cheapest_split(name, counts):
    total = sum(counts.values())
    assert U.Segmenter(counts)(name) == cheapest(name, counts, total)
