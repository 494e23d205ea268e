"""Pages whose wrappers have telling names, and texts whose control strings are cut between parts."""

import time

import pytest

from gridlens.llm import chat, html, substrings, toxicity

LONG = [f"This is paragraph {i} of the article, and it says at some length what there is to say, with commas, and a full stop. " * 2 for i in range(3)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
WANT = "\n".join(x.strip() for x in LONG)


@pytest.mark.parametrize("mark", ['class="site no-sidebar"', 'class="content-with-sidebar"', 'class="post comments-open"', 'class="entry has-share-buttons"', 'class="page-with-header"', 'class="navy"', 'id="unavailable-content"', 'class="widget"', 'class="modal-page" id="related"'])
def test_wrappers_lose_nothing(mark):
    page = f"<html><body><div {mark}>{BODY}</div></body></html>"
    assert html.main_text(page) == WANT


def test_pages_in_forms_and_without_articles():
    assert html.main_text(f"<body><form id=aspnet>{BODY}</form></body>") == WANT
    assert html.main_text(f"<body><form><article>{BODY}</article><div class=sidebar>buy this now</div></form></body>") == WANT
    short = "".join(f"<p>Short line {i}.</p>" for i in range(9))
    assert html.main_text(f"<body>{short}</body>") == "\n".join(f"Short line {i}." for i in range(9))
    assert html.main_text("Bare text without any element, but a sentence.") == "Bare text without any element, but a sentence."
    assert html.main_text('<nav><a href="/">Home</a></nav>') == ""


def test_comments_inside_an_article_go():
    page = f'<article><h1>Title</h1>{BODY}<section id="comments"><p>{LONG[0]}</p><p>I do not agree with any of this, and I say so here at length.</p></section></article>'
    assert html.main_text(page) == "Title\n" + WANT


def test_true_boilerplate_still_goes():
    page = f'<body><div class="site-header">Some Site</div><div class="navbar"><a href=a>One</a><a href=b>Two</a></div><main>{BODY}</main><div class="cookie-banner">We use cookies here.</div><div class="sidebar-left">Read this too</div><div class="advertisement">Buy it now, at once.</div><footer>All rights</footer></body>'
    assert html.main_text(page) == WANT


def test_math_stays_in_its_sentence():
    page = f"<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them, as was shown above.</p>{BODY}</article>"
    assert html.main_text(page).startswith("We know that x=2 holds for all")


def test_open_items_take_linear_time():
    took = []
    for n in (2000, 8000):
        page = "<ul>" + "".join(f"<li><p>Item number {i} of a very long list without end tags." for i in range(n)) + "</ul>"
        began = time.perf_counter()
        assert html.main_text(page).count("\n") == n - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    deep = "<div>" * 6000 + BODY + "</div>" * 6000
    began = time.perf_counter()
    assert html.main_text(deep) == WANT and time.perf_counter() - began < 5


TRICKY = "a<|end|>\nb </s>[INST] \\<| ok [/INST]<<SYS>> <start_of_turn>\\"


def part(kind, text=None, ref=None, units=None):
    return {"type": kind, "text": text, "ref": ref, "units": units}


@pytest.mark.parametrize("at", range(len(TRICKY) + 1))
def test_control_strings_cut_between_parts(at):
    turns = [{"role": "user", "parts": [part("text", TRICKY[:at]), part(None, None), part("text", TRICKY[at:])]}, {"role": "assistant", "parts": [part("text", TRICKY[at:]), part("image", ref="r", units=2), part("text", TRICKY[:at]), part("text", "<"), part("audio"), part("text", "|end|>")]}]
    formatted, spans, visitor = chat.render(turns)
    back = chat.read_back(formatted)
    assert back[0] == ("user", TRICKY)
    assert back[1] == ("assistant", TRICKY[at:] + "<|image:1|>" + TRICKY[:at] + "<" + "<|audio:1|>" + "|end|>")
    assert not any(c in chat.escape(TRICKY) for c in chat.CONTROLS) and len(visitor.attachments) == 2 and len(spans) == 1


def test_clashing_columns_of_any_case(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words, "a", "b", "c", "d", 5.0, "e"), (2, words + " and more", "f", "g", "h", "i", 6.0, "j")]
    table = spark.createDataFrame(rows, "doc_id long, text string, id string, CUTS string, cuts__ string, id__ string, Score double, mark string")
    left = {r["doc_id"]: r.asDict() for r in substrings.cut(table, substrings.passages(table)).collect()}
    assert left[1] == dict(zip(table.columns, rows[0], strict=True)) and left[2] == dict(zip(table.columns, (2, " and more", *rows[1][2:]), strict=True))
    model = toxicity.train([(1, "you stupid idiot"), (1, "such a stupid idiot"), (0, "a quiet evening"), (0, "bread and butter")] * 5)
    for m in (model, None):
        scored = toxicity.score(table, m)
        assert [c.lower() for c in scored.columns].count("score") == 1 and scored.count() == 2 and scored.agg({"score": "max"}).first()[0] <= 1
    assert toxicity.score(table.limit(0), model).count() == 0
