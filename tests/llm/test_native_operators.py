"""URL filter and line rules: plain computations, known answers, and plans without Python."""

from __future__ import annotations

import brute
import pytest
from gridlens.llm import line_rules, url_filter
from gridlens.llm.components import connected_components
from gridlens.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, rule int"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_base_counts(documents, texts):
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words): r for r in line_rules.line_first(documents).collect()}
    assert set(found) == {(k, *brute.base_counts(t)) for k, t in texts}
    for (_, n, _, _, _, repeated), r in found.items():
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.kept and r.base_failed)
    assert "Python" not in plan(line_rules.line_first(documents)) and "Arrow" not in plan(line_rules.line_first(documents))


@pytest.mark.parametrize("line,fails", [
    ("This is an ordinary sentence.", False), ("A longer line of prose that simply lacks its last mark", False), ("Buy now", True),
    ("Home | About | Contact | Login", True), ("we use cookies to improve your visit.", True), ("a%%% b$$$ c### d*** e&&& f%%%.", True),
    ("one | two | three | four | five.", True), ("Quoted: “so it was.”", False)])
def test_lines(spark, line, fails):
    text = "Some words that are clearly prose and long enough to stay.\n" + line
    row = line_rules.line_first(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_removed_lines == int(fails) and (line in row.cleaned) != fails


def test_lost_text_is_rejected(spark):
    good = "These words are a fine sentence of ordinary prose, long enough for all rules."
    bad = "Home | About | Contact | Login | Search | Help | Register | Menu | Sitemap | FAQ | Home | About | More | Less"
    rows = [(1, good), (2, good + "\n" + bad + "\n" + bad), (3, None), (4, "")]
    kept = {r.doc_id: r.kept for r in line_rules.line_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def page(head: str) -> str:
    return f"<html><head>{head}</head><body>text</body></html>"


def test_urls(spark):
    canonical = lambda to: page(f'<link href="{to}" rel="canonical">')
    rows = [
        (1, "http://a.example.net/x", canonical("https://B.example.com/de/1?q#f"), "allow is explicit for none"),
        (2, "http://c.example.net/", page('<META http-equiv="Refresh" content="0; URL=http://a.example.net/x#top">'), ""),
        (3, "http://d.org/", canonical("http://a.example.net/x"), ""),
        (4, "https://b.example.com/de/1?q", None, ""),
        (5, "http://e.example.net/", page('<!-- <link rel=canonical href="http://a.example.net/x"> -->'), ""),
        (6, None, canonical("http://a.example.net/x"), ""), (7, "no scheme", canonical("http://a.example.net/x"), ""), (8, "", "", ""),
        (9, "http://f.example.net/p/q", page("<link rel=canonical href=../r>"), ""), (10, "http://f.example.net/y", canonical("/z"), ""),
        (11, "http://f.example.net/z", canonical("//a.example.net/x"), ""), (1, "http://a.example.net/x", None, ""),
        (12, "HTTP://WWW.Example.ORG/en/12?x", None, ""), (13, "http://example.org", None, ""), (14, "http://xcom/de/", None, ""),
        (15, "http://x.com/fr/de?/", None, ""), (16, "http://g.example.net/", canonical("http://h.example.net/"), ""),
    ]
    table = spark.createDataFrame([(i, u, h, n, 1) for i, u, h, n in rows], PAGES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table, URL_RULES).collect()}
    assert found[1] == ("a.example.net", "/x", None, "block") and found[2][3] == "block"
    assert found[3] == ("d.org", "/", "org/", "allow")
    assert found[4] == ("b.example.com", "/de/1", "com/de/", "block")
    assert found[5][3] == "allow" and found[6] == found[7] == found[8] == ("", "", None, "allow")
    assert found[9][3] == "allow" and found[10][3] == "block" and found[11][3] == "block"
    assert found[12] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert found[13] == ("example.org", "", None, "allow") and found[14] == ("xcom", "/de/", None, "allow")
    assert found[15] == ("x.com", "/fr/de", "com/fr/", "allow") and found[16][3] == "allow"
    assert url_filter.judge_urls(table, URL_RULES).count() == len(rows)
    assert "Python" not in plan(url_filter.judge_urls(table, URL_RULES)) and "Arrow" not in plan(url_filter.judge_urls(table, URL_RULES))
    moved = spark.createDataFrame([("http://g.example.net/#a", "http://i.example.com/de/"), (None, "http://x.com/de/")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(table, URL_RULES, redirects=moved).collect()}[16] == "block"
    assert url_filter.judge_urls(table.limit(0), URL_RULES).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3), (300, 301), (301, 300), (302, 301)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(200, 260)) and roots[302] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
