"""Pages, urls and personal data."""

import random
import re

from lumenkg.llm.html_extract import extract_main_text, main_text
from lumenkg.llm.pii import base_spans, find_personal_data, luhn
from lumenkg.llm.url_filter import RULES, UrlRule, judge_urls

LONG = "The cat is in the house and it was on the mat, which is what we have for you in this one and that is all there is to it in the end."


def test_article_is_kept_whole_and_the_rest_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></nav>
    <!-- ad --><div class="ad">{LONG}</div><article><h1>Head &amp; shoulders</h1><p><b>{LONG}<br>
    <p>Short.</p><div class="comments"><p>{LONG}</div><p>a&nbsp;b</p></article><aside>{LONG}</aside><form>{LONG}</form><footer>&copy; x</footer>"""
    assert main_text(page) == f"Head & shoulders\n{LONG}\nShort.\na b"


def test_pages_without_article():
    page = f"<body><div id=menu><a href=x>a</a></div><h2>Title</h2><p>{LONG}<p>Short.<p>{LONG}<div class='cookie-notice'>{LONG}</div><p><a href=y>{LONG}</a>"
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "&amp", "<p class='", "plain"):
        assert isinstance(main_text(odd), str)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<article>a"), (None, "v", "")], "page_id long, url string, html string")
    assert [(r.page_id, r.url, r.text) for r in extract_main_text(spark, pages).collect()] == [(1, None, ""), (1, "u", "a"), (None, "v", "")]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def test_urls_both_ways(spark):
    rng = random.Random(8)
    hosts = ["org", "example.org", "a.example.org", "a.b.example.org", "xexample.org", "com", "x.com", "EXAMPLE.org", "", "org.", "-example.org", "example-x.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12?x", "/de/#a", "/fr/"]
    rows = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}", "z") for i in range(300)] + [(900, None, "z"), (901, "no scheme", "z"), (901, "a://b://c/d", "z"), (None, "http://x.com/fr/", "z")]
    rules = RULES + [UrlRule("block", "b.example.org", "/"), UrlRule("allow", "a.b.example.org", "/es")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = [{(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark, pages, rules, max_swept_rules=m).collect()} for m in (100, 2)]
    want = set()
    for i, url, _ in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        r = plain_rule(host, path, rules)
        want.add((i, host, path, r and r.name, r.verdict if r else "allow"))
    assert got[0] == want and got[1] == want
    assert judge_urls(spark, pages.limit(0), rules).count() == 0


def test_base_spans():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    text = "mail a.b@c-d.example.com, b@c 10.0.0.255 10.0.0.256 1.2.3.4.5, 4111 1111 1111 1111 +1 (212) 555-0199 +12 é x@y.z"
    assert [(k, text[s:e]) for k, s, e in base_spans(text)] == [("email", "a.b@c-d.example.com"), ("email", "x@y.z"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0199")]
    assert base_spans(None) == [] and base_spans("9" * 6000 + ".1.1.1") == []


def test_contexts_find_unseen_numbers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()} call us at +1 (212) 555-{1000 + i} {word()}", 0) for i in range(20)]
    rows += [(100, "please call us at 212 555 7777 today", 0), (101, f"{word()} 212 555 7777 {word()}", 0), (102, None, 0), (103, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = {r.doc_id: r for r in find_personal_data(spark, docs).collect()}
    assert [(x.kind, rows[20][1][x.start : x.end]) for x in got[100].extra] == [("phone", "212 555 7777")]
    assert got[101].extra == [] and got[102].base == [] and len(got) == len(rows)
    assert find_personal_data(spark, docs.limit(0)).count() == 0
