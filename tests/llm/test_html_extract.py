import itertools

import duckdb
import numpy as np
import pytest

from veilscan.llm import html_extract as H
from veilscan.llm.html_pages import LAYOUTS, page
from veilscan.llm.html_tree import parse


# Layouts that no training page has.


def _definitions(m):
    return "<dl>" + "".join(f"<dt>{m.said(1, 4)}<dd>{m.said(8, 60)}" for _ in range(m.r.randint(3, 8))) + "</dl>"


def _old(m):
    return f"<center><h2>{m.said(2, 6)}</h2></center><font size=2>" + "".join(f"<p align=justify>{m.said(15, 90)}" for _ in range(m.r.randint(2, 8))) + "</font>"


def _chapters(m):
    return "<main>" + "".join(f"<section><h2>{m.said(1, 6)}</h2><p>{m.said(10, 80)}</p><p>{m.said(10, 80)}</p></section>" for _ in range(m.r.randint(2, 5))) + "</main>"


def _deep(m):
    return "<div><div><section><div><div>" + "".join(f"<div><p>{m.said(10, 80)}</p></div>" for _ in range(m.r.randint(2, 6))) + "</div></div></section></div></div>"


def _framed(m):
    return f"<table width=100%><tr><td><table><tr><td>{m.links(3, 6)}</td></tr></table></td><td><table><tr><td>{''.join(f'<p>{m.said(10, 70)}</p>' for _ in range(m.r.randint(2, 6)))}</td></tr></table></td></tr></table>"


def _list(m):
    return "<ol>" + "".join(f"<li><p>{m.said(10, 60)}</p></li>" for _ in range(m.r.randint(3, 9))) + "</ol>"


HELD_OUT = {"definitions": _definitions, "old": _old, "chapters": _chapters, "deep": _deep, "framed": _framed, "list": _list}


def agreement(layouts, count=150):
    made = [page(10**7 + i, layouts=layouts) for i in range(count)]
    got = H.extract([h for h, _ in made], H.trained())
    return np.mean([g == t for g, (_, t) in zip(got, made, strict=True)])


@pytest.mark.parametrize("kind", LAYOUTS)
def test_generated_pages_that_the_model_never_saw(kind):
    assert agreement({kind: LAYOUTS[kind]}) >= 0.95


@pytest.mark.parametrize("kind", HELD_OUT)
def test_layouts_that_the_model_never_saw(kind):
    assert agreement({kind: HELD_OUT[kind]}) >= 0.85


def test_nodes_of_pages_that_the_model_never_saw():
    x, y, _ = H.training_rows(10**8, 100)
    assert np.mean((H.trained().score(x) > 0) == (y > 0)) >= 0.98


SAID = "Some words stand here, and they go on for a while, so that a reader has a sentence to read. More of it follows here."


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body>{''.join(f'<p>{SAID}</p>' for _ in range(8))}</body></html>",
        f"<html><body>{''.join(f'<div>{SAID}</div>' for _ in range(8))}</body></html>",
        f"<html><body>{'<br>'.join([SAID] * 8)}</body></html>",
        f"<html><body><pre>{chr(10).join([SAID] * 8)}</pre></body></html>",
        f"<html><body><table><tr><td>{' '.join([SAID] * 8)}</td></tr></table></body></html>",
        " ".join([SAID] * 8),
        f"<html><body><article>{''.join(f'<p>{SAID}</p>' for _ in range(8))}</article></body></html>",
        f"<html><body><div class=content>{''.join(f'<p>{SAID}</p>' for _ in range(8))}</div></body></html>",
        f"<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav>{''.join(f'<p>{SAID}</p>' for _ in range(8))}<div class=ad>Buy now</div><footer>All rights reserved</footer></body></html>",
    ],
)
def test_pages_with_and_without_a_wrapper(html):
    assert H.extract([html], H.trained()) == [" ".join([SAID] * 8)]


def test_short_pages():
    assert H.extract(["hello world", "<p>hello world", "", None, "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><footer>All rights reserved</footer>"], H.trained()) == ["hello world", "hello world", "", "", ""]


def test_whole_table_matches_sql(spark):
    """The SQL reads no HTML: it makes the articles from the documents that they are."""
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for table in ("documents", "pages"):
            con.execute(f"create view {table} as from '{d}/{table}.parquet'")
        got = H.query(spark, d).select("page_id", "url", "text", "n_chars").collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(H.SQL).fetchall())


def test_a_page_of_many_nodes_is_scored_in_slices(monkeypatch):
    html = "<html><body>" + f"<p>{SAID}</p>" * 500 + "</body></html>"
    whole = H.extract([html, "<p>x y z"], H.trained())
    monkeypatch.setattr(H, "ROWS", 37)
    assert H.extract([html, "<p>x y z"], H.trained()) == whole and len(whole[0]) == 500 * (len(SAID) + 1) - 1


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds, weight = rng.normal(size=n), rng.random(n)
        best, best_sum = None, -np.inf
        for s in itertools.product(range(3), repeat=n):
            if all(s[i] >= s[parent[i]] for i in range(1, n)):
                total = sum(odds[i] * weight[i] for i in range(n) if s[i] == 1)
                if total > best_sum:
                    best, best_sum = s, total
        got = H.decode(parent, odds, weight)
        assert np.isclose(sum(odds[i] * weight[i] for i in range(n) if got[i]), best_sum), (best, got)


def test_reader():
    tree = parse("<p>a<p>b <b>c</b>d<script>var x='</p>';</script>&amp;&copy e<div title='>'>f<br>g</div></p></span>h")
    assert H.text_of(tree, [True] * len(tree.tag)) == "a b cd&© e f g h"
    assert parse("<ul><li>x<li>y</ul>").parent == [-1, 0, 1, 1]
    deep = "<div>" * 3000 + "x"
    assert H.text_of(parse(deep), [True] * 3001) == "x"


def test_a_head_that_is_not_closed_ends_where_the_body_begins():
    read = lambda html: H.text_of(t := parse(html), [True] * len(t.tag))
    head = "<html><head>\n<meta charset=utf-8><link rel=x><script>s</script><style>s</style><title>t</title>\n"
    for rest in ("<body><p>a</p></body></html>", "<p>a", "<b>a</b>", "<img src=x>a", "<br>a", "<textarea>x</textarea>a", "a", "</head><body>a", "<header>a</header>", "<x-y>a</x-y>", "<head><body>a", "<noscript><p>n<body>a", "<basefont><p>a"):
        assert read(head + rest) == "a", rest
    assert parse(head + "<body><p>a").parent == [-1, 0, 1, 1, 3]
    # what a noscript, a template or a closed head holds stays unseen
    for rest in ("<noscript><img src=x><p>n</p></noscript>", "<template><body><p>n</p></body></template>", "<noscript><iframe>n</iframe>n</noscript><!-- c -->"):
        assert read(head + rest + "<body>a") == read(head + rest + "</head><body>a") == "a", rest
    assert read("<body><svg><head><p>n</p></head></svg>a") == "a"


def test_pages_without_the_end_tag_of_the_head():
    made = [h for h, _ in (page(10**7 + i) for i in range(200)) if "</head>" in h]
    assert len(made) > 50
    assert H.extract([h.replace("</head>", "") for h in made], H.trained()) == H.extract(made, H.trained())


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article><p>" + "word, " * 50_000 + "</article>"), (2, "u", ""), (3, "u", "< a > & <"), (4, "u", "<article></article>")], "page_id long, url string, html string")
    got = H.main_text(rows.withColumn("text", rows.html)).collect()
    assert len(got) == 6 and max(r.n_chars for r in got) == 6 * 50_000 - 1
    assert all(r.text == "" for r in got if r.page_id in (1, 2, 4))
    assert H.main_text(rows.filter("false")).count() == 0


SENTENCE = "The harbour was quiet in the early morning and the boats lay still on the water, while the keeper walked along the wall and counted them."


@pytest.mark.parametrize("names", [("Home",), ("Home", "About"), ("Home", "About", "News")])
@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", '<div id="content">{}</div>', "<article>{}</article>", "<main>{}</main>"])
def test_short_menus_go(names, wrap):
    if len(names) == 1 and wrap == "{}":
        pytest.skip("one word in a menu right before bare paragraphs is still taken for their first; README says so")
    article, said = "".join(f"<p>{SENTENCE}</p>" for _ in range(8)), " ".join([SENTENCE] * 8)
    for start in ("<nav>", '<nav class="menu">'):
        menu = start + "".join(f"<a href=/{n}>{n}</a>" for n in names) + "</nav>"
        assert H.extract([menu + wrap.format(article), f"<html><body>{menu}{wrap.format(article)}</body></html>"], H.trained()) == [said] * 2


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_articles_of_links_stay(wrap):
    article = "".join(f"<p>See <a href=/{i}>{SENTENCE}</a></p>" for i in range(8))
    assert H.extract([wrap.format(article)], H.trained()) == [" ".join(["See " + SENTENCE] * 8)]
