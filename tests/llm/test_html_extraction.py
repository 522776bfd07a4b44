import random

import pytest
from threadloom.llm import html_extraction as hx

SCHEMA = "page_id long, url string, html string, host string, text string, element int"


def page(paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>t</title><script>var a='</p><article>';</script></head><body><nav><ul><li><a href=x>n</a></li></ul></nav><div class='page'><div class=\"ad\">buy</div><article><header><h1>T &amp;amp; t</h1></header>{body}{extra}</article><aside>s</aside></div><footer>&copy; f</footer></body></html>"


def wrapper(*pages):
    found = hx.inferred(pages[0])
    for p in pages[1:]:
        found = hx.aligned(found, hx.inferred(p))
    return found


def test_article_without_what_stands_around_it():
    extra = '<div class="comments"><p>nice</p></div><form><p>mail</p></form><!-- <p>no</p> --><p>a<b>b</b> c<br>d &#233;  \n e<p>open<div id="share-bar">x</div>'
    assert hx.main_text(page(["one", " two  words "], extra)) == "T &amp; t\none\ntwo words\nab c d é e\nopen"
    assert hx.main_text("") == hx.main_text(" <!-- x -->") == ""
    assert hx.main_text("plain text") == "plain text"
    assert hx.main_text("<article><p>never closed") == "never closed"
    assert hx.main_text("<article><p>" + "long " * 200_000).count("long") == 200_000
    assert hx.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_wrappers_align():
    """Optional and repeated groups, constants and slots, in order; wrappers survive writing and merge in any order of tasks."""
    a, b, c = page(["x one"]), page(["x one", "y", "z"]), page(["other"], "<aside>q</aside>")
    whole = wrapper(a, b, c)
    text = hx.expression(whole)
    assert "( p # /p )+" in text and "( aside =" in text and ")?" in text and "h1 =" in text
    assert hx.expression(hx.read_wrapper(hx.written_wrapper(whole))) == text
    parts = hx.aligned(wrapper(a), wrapper(b, c))
    assert hx.expression(parts) == text and parts.pages == 3


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "river", "stone"]) + str(rng.randrange(99)) for _ in range(n))


def site(rng, links, layout):
    """A page without article or main, and its text."""
    menu = "".join(f"<li><a href=/{i}>Section {i} of the site</a></li>" for i in range(links))
    paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    body = "<p>".join(["", *paragraphs])
    rail = "".join(f"<p><a href=x>{words(rng, 4)}</a></p>" for _ in range(5))
    text = "\n".join(paragraphs)
    if layout == "classes":
        return f"<body><div class=top><ul>{menu}</ul></div><div class=story>{body}</div><div class=rail>{rail}</div></body>", text
    if layout == "plain":
        return f"<body><div><ul>{menu}</ul></div><div>{body}</div><div>{rail}</div><div>All rights reserved by the owner</div></body>", text
    if layout == "flat":
        return f"<body><ul>{menu}</ul>{body}<p>All rights reserved by the owner</p></body>", text
    # constants inside the article's own element, and an optional notice
    notice = "<div><b>Please switch the other thing on</b></div>" if rng.random() < 0.5 else ""
    return f"<body><table><tr><td><ul>{menu}</ul></td><td>{notice}<h2>{words(rng, 5)}</h2>{body}<h5>Follow us everywhere</h5></td></tr></table></body>", None


@pytest.mark.parametrize("links", [1, 8, 300])
@pytest.mark.parametrize("layout", ["classes", "plain", "flat"])
def test_hosts_without_article_elements(links, layout):
    """Menus, link rails and constants go by the wrapper alone, whatever their length."""
    rng = random.Random(links)
    pages = [site(rng, links, layout) for _ in range(8)]
    whole = wrapper(*(p for p, _ in pages))
    for html, text in pages:
        assert hx.main_text(html, whole) == text
    # two layouts of one host do not disturb each other
    mixed = wrapper(*(p for p, _ in pages), *(page([words(rng, 40)]) for _ in range(4)))
    assert [hx.main_text(p, mixed) for p, _ in pages] == [t for _, t in pages]


def test_constants_inside_the_article_go():
    rng = random.Random(5)
    pages = [site(rng, 5, "table")[0] for _ in range(12)]
    whole = wrapper(*pages)
    for p in pages:
        text = hx.main_text(p, whole)
        assert "Follow us" not in text and "Please switch" not in text and "Section" not in text and len(text.split("\n")) >= 3


def test_equal_pages_are_no_template(spark):
    """A host that shows one page many times keeps its text."""
    html, text = site(random.Random(1), 5, "classes")
    df = spark.createDataFrame([(i, "http://a/", html, None, None, None) for i in range(30)], SCHEMA)
    assert {r.text for r in hx.main_texts(df).collect()} == {text}


def test_tags_of_the_article_do_not_matter(spark):
    """The same text with article and div in its place."""
    rng = random.Random(2)
    pages = [page([words(rng, 30) for _ in range(rng.randint(1, 5))]) for _ in range(20)]
    other = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    a, b = wrapper(*pages), wrapper(*other)
    assert [hx.main_text(p, a) for p in pages] == [hx.main_text(p, b) for p in other]


def test_rows(spark, monkeypatch):
    rows = [(i, f"https://U@a.Example.org:80/{i}", page([f"p{i}", f"q{i}"] * (1 + i % 3)), "h", "t", 1) for i in range(50)]
    rows += [(50, None, None, None, None, None), (51, "x", "", None, None, None), (1, "http://b/", page(["again"]), None, None, None), (None, "http://b", "<p>null id", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hx.main_texts(df.repartition(5)).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): (r.text, r.n_chars) for r in got}
    assert texts[4, rows[4][1]] == ("p4\nq4\np4\nq4", 11)
    assert texts[50, None] == texts[51, "x"] == ("", 0)
    assert texts[None, "http://b"] == ("null id", 7)
    assert {r.host for r in hx.wrappers(df.repartition(5)).collect()} == {"a.example.org", "b"}
    monkeypatch.setattr(hx, "BROADCAST_BYTES", 0)
    assert sorted(map(str, hx.main_texts(df.repartition(5)).collect())) == sorted(map(str, got))
    assert hx.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


KEPT_NAMES = ["side-effects", "search-methods", "notice-period", "related-work", "share-capital", "menu-planning", "comment-culture", "ad-hoc"]


def article_page(rng, i):
    """A page whose article holds sections with telling names, a list of links and a sentence that all pages share; and its text."""
    title, lead = words(rng, 5), words(rng, 30)
    parts = [f"<section {rng.choice(['class', 'id'])}='{name}'><h2>{name} {i}</h2><p>{words(rng, 20)}</p></section>" for name in KEPT_NAMES]
    links = "".join(f"<li><a href=/r{k}>{words(rng, 3)}</a></li>" for k in range(6))
    body = f"<h1>{title}</h1><p>{lead}</p>{''.join(parts)}<p>All figures are in euros.</p><ul>{links}</ul>"
    html = f"<html><body><nav><a href=/>home</a></nav><div class='ad'><p>buy now</p></div><article>{body}</article><footer>&copy; all of us</footer></body></html>"
    import re

    text = [re.sub("<[^>]*>", "", x).strip() for x in re.split("(?=<(?:h1|h2|p|li|section|ul))", body)]
    return html, "\n".join(x for x in text if x)


@pytest.mark.parametrize("pages", [1, 2, 8, 30])
def test_nothing_of_the_article_is_lost(pages):
    rng = random.Random(pages)
    made = [article_page(rng, i) for i in range(pages)]
    whole = wrapper(*(p for p, _ in made))
    for html, text in made:
        assert hx.main_text(html, whole) == text


def test_texts_do_not_depend_on_partitions(spark):
    """Pages of several layouts of a few hosts, dealt out in several ways."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        html = rng.choice([lambda: article_page(rng, i)[0], lambda: site(rng, 5, rng.choice(["classes", "plain", "flat", "table"]))[0], lambda: page([words(rng, 20)])])()
        rows.append((i, f"http://h{i % 3}/", html, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    texts = [{r.page_id: r.text for r in hx.main_texts(x).collect()} for x in (df.repartition(7), df.coalesce(1), df.orderBy("html").repartition(3))]
    assert texts[0] == texts[1] == texts[2]
