import random
import zlib
from collections import Counter

import numpy as np
import pytest

import re
import time
from collections import defaultdict
from itertools import combinations

from spreadgraph.llm.html import blocks, extract_main_text, main_text, path_ratios, smooth
from spreadgraph.llm.toxicity import FactorizationMachine, Terms, drop_toxic, fit, score_toxicity, train

# -------------------------------------------------------------------------------------------------------------- toxicity


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = rng.choices(words, k=rng.randrange(5, 120))
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["Idiot,", "scum", "vilezer", "vileness", "vilex"]))
        rows.append((i, " ".join(text), "en", 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right / len(held) > 0.95
    kept = {r["doc_id"] for r in drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lied = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels] + [(None, 1), (3, None)]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, lied))
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.w, b.w) and a.bias == b.bias


def test_pairs_are_learned_that_single_terms_miss():
    # label 1 only if both stand together
    rng = random.Random(3)
    samples, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        samples.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *rng.sample(range(10, 60), 5)})))
        y.append(int(a and b))
    m = fit(samples, np.array(y), epochs=300)
    one = lambda *t: m.score(np.array(t))
    assert one(1, 2) > 0.5 and one(1) < 0.5 and one(2) < 0.5
    assert float(m.v[m.rows(np.array([1]))[0]] @ m.v[m.rows(np.array([2]))[0]]) > 0


def test_a_rare_pair_is_learned_whose_words_tell_little_alone():
    rng = np.random.default_rng(1)
    n = 8000
    y = (rng.random(n) < 0.11).astype(int)
    at = rng.permutation(n)
    both, a, b = at[:20], at[20:400], at[400:780]
    y[both] = 1
    samples = [set((100 + rng.integers(0, 1000, 20)).tolist()) for _ in range(n)]
    for word, rows in ((1, [*both, *a]), (2, [*both, *b])):
        for i in rows:
            samples[i].add(word)
    m = fit([np.array(sorted(s)) for s in samples], y)
    assert m.score(np.array([1, 2])) > 0.9 and m.score(np.array([1])) < 0.5 and m.score(np.array([2])) < 0.5


def test_toxicity_edge_cases(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(none, labels)
    assert score_toxicity(none, model).collect() == []
    odd = spark.createDataFrame([(None, None), (2**60 + 1, ""), (1, "x " * 50000), (1, "x " * 50000)], schema)
    got = score_toxicity(odd, model).collect()
    assert len(got) == 4 and {r["doc_id"] for r in got} == {None, 2**60 + 1, 1} and all(r["score"] < 0.5 for r in got)


def explicit_score(machine, buckets):
    """The machine's formula, pair by pair."""
    known = {int(t): (float(w), v) for t, w, v in zip(machine.terms, machine.w, machine.v, strict=True)}
    own = [known[int(b)] for b in buckets if int(b) in known]
    y = machine.bias + sum(w for w, _ in own) + sum(float(np.dot(p[1], q[1])) for p, q in combinations(own, 2))
    return 1 / (1 + np.exp(-min(max(y, -30), 30)))


def test_scores_are_the_explicit_sum_over_pairs(spark):
    rng = np.random.default_rng(4)
    terms = np.unique(rng.integers(0, 1 << 20, 4000))
    words = [f"word{i}" for i in range(3000)]
    own = np.unique(np.concatenate([Terms()(w) for w in words[:1500]]))
    machine = FactorizationMachine(np.union1d(terms, own), *(lambda m: (rng.normal(0, 0.3, m), rng.normal(0, 0.2, (m, 4))))(len(np.union1d(terms, own))), -0.5)
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, " ".join(words))]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(explicit_score(machine, Terms()(text)), abs=1e-9)
    assert len({round(s, 6) for s in got.values()}) > 100


def test_terms_are_bounded_and_repeatable():
    t = Terms(1 << 10)
    a = t("Loser losers, LOSER")
    assert (a < 1 << 10).all() and (np.diff(a) > 0).all() and np.array_equal(a, Terms(1 << 10)("loser losers"))


# ------------------------------------------------------------------------------------------------------------------ html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var a="</p><p>no";</script></head><body class="post">
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="ad">Buy this now, it is good. Really, it is.</div><!-- <p>no</p> -->
<main><article><h1>Title   here</h1><p>First &lt;para&gt;, with <b>bold</b>&nbsp;text
 and lines.<p>Second one: longer text, with commas, and more. <br>After a break<ul><li>Item one<li>Item <i>two</i></ul>
<div class="share-buttons"><a href=#>Share</a></div><p>Be.</p><form><input value=x><p>Mail us!</p></form></article>
<section id="comments"><p>A reader says something long, very long, and rude. Yes.</p></section></main>
<aside><p>Side text, which is long, long, long. And longer.</p></aside><div class="cookie-notice"><p>We use cookies, many.</p></div><footer>&copy; me</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert main_text(PAGE).split("\n") == ["Title here", "First <para>, with bold text and lines.", "Second one: longer text, with commas, and more. After a break", "Item one", "Item two", "Be."]


def test_content_found_by_ratios_without_names():
    menu = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
    body = "".join(f"<p>Sentence {i}, with a clause, and another one. It goes on for a while.</p>" for i in range(8))
    page = f"<html><body><table><tr><td><ul>{menu}</ul></td><td><div>{body}<p>End.</p></div></td></tr></table></body></html>"
    assert main_text(page).split("\n")[-1] == "End." and "Link" not in main_text(page)


LONG = "".join(f"<p>Sentence {i}, with a clause, and another one. It goes on for a while.</p>" for i in range(20))


@pytest.mark.parametrize(
    ("page", "first", "last"),
    [
        (f"<article><h1>Title</h1><div class=entry-content>{LONG}</div></article>", "Title", None),
        (f"<main><h1>Title</h1><p>By me</p><article>{LONG}</article></main>", "Title", None),
        (f"<article><div class=lead><p>A lead</p></div><div class=body>{LONG}</div><div class=end><p>Bye</p></div></article>", "A lead", "Bye"),
        (f"<body><section id=s1><p>Short one.</p></section><section id=s2>{LONG}</section><section id=s3><p>Bye</p></section></body>", "Short one.", "Bye"),
        (f"<body><article id=a1>{LONG}</article><article id=a2><p>Bye</p></article></body>", "Sentence 0", "Bye"),
        (f"<div class=wrap><h1>Title</h1><p>By me</p><div class=entry>{LONG}</div></div>", "Title", None),
        (f"<div class=wrap><div class=top><a href=/>Home</a></div><div class=entry>{LONG}</div><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>", "Sentence 0", None),
    ],
)
def test_content_in_wrappers_and_several_sections(page, first, last):
    got = main_text(page).split("\n")
    assert got[0].startswith(first) and got[-1].startswith(last or "Sentence 19,")
    assert sum(t.startswith("Sentence") for t in got) == 20 and ("<p>By me" not in page or got[1] == "By me")


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-header", "menu-open", "legal-news", "related-topic", "sidebar"])
def test_marks_of_the_layout_around_the_content(name):
    side = "<div class=sidebar><p>Side text, which is long, long. And longer.</p></div><div id=comments><article><p>Rude, very.</p></article></div>"
    for page in (f"<div class={name}><article>{LONG}</article>{side}</div><p>End</p>", f"<div class={name}><div>{LONG}</div></div>"):
        got = main_text(page)
        assert got.count("Sentence") == 20 and "Side" not in got and "Rude" not in got


def test_marks_stay_where_they_name_what_is_beside():
    teasers = "<article class=teaser><p>Teaser, short.</p></article>" * 3
    page = f"<div class=text>{LONG}</div><div class=sidebar>{teasers}</div><div class=comment-list><article><p>{'Rude, so rude. ' * 200}</p></article></div>"
    got = main_text(page)
    assert got.count("Sentence") == 20 and "Teaser" not in got and "Rude" not in got
    assert main_text("<div class=cookie-notice><p>We use cookies, many.</p></div>") == ""


def test_figures_addresses_and_formulas_are_text():
    page = f"<article>{LONG}<figure><table><tr><td>Cell 1</table><figcaption>A caption</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p><object>Instead</object><address>Main Street 1</address></article>"
    assert main_text(page).split("\n")[20:] == ["Cell 1", "A caption", "So x=2 holds.", "Instead", "Main Street 1"]


def naive_text(found):
    """The content by the stated rules, on whole paths, each compared step by step."""
    tag = lambda step: step.split(".")[0]
    if not found:
        return ""
    n, chars, marks, links, solid = (defaultdict(float) for _ in range(5))
    for b in found:
        n[b.path] += 1
        chars[b.path] += len(b.text)
        marks[b.path] += len(re.findall("[.,;:!?。，！？；：、]", b.text))
        links[b.path] += b.link_chars
        solid[b.path] += len("".join(b.text.split()))
    ratio = {p: chars[p] / n[p] * (1 + marks[p] / n[p]) * max(0, 1 - links[p] / max(chars[p], 1)) ** 2 for p in n}
    at = [ratio[b.path] for b in found]
    level = [0.25 * at[max(i - 1, 0)] + 0.5 * at[i] + 0.25 * at[min(i + 1, len(at) - 1)] for i in range(len(at))]
    bar = 0.5 * sum(x * len(b.text) for x, b in zip(level, found, strict=True)) / max(sum(len(b.text) for b in found), 1)
    content = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
    weight = lambda b: (2 if any(s.startswith(("article", "main")) or content.search(s.replace(".", " ")) for s in b.path) else 1) * len(b.text)
    voters = [b for b, x in zip(found, level, strict=True) if x >= bar]
    above = {b.path[:k] for b in voters for k in range(len(b.path) + 1)}
    held = {p: sum(weight(b) for b in voters if b.path[: len(p)] == p) for p in above}
    enough = [p for p in above if held[p] >= 0.8 * sum(map(weight, voters)) and not (p and tag(p[-1]) in "p h1 h2 h3 h4 h5 h6 li blockquote pre td ul ol".split())]
    own = max(enough, key=len, default=())
    prose = [2 * links[b.path] < solid[b.path] for b in found]
    if {"article", "main"} & set(map(tag, own)):
        inside = [bool({"article", "main"} & set(map(tag, b.path))) for b in found]
    else:
        inside = [b.path[: len(own)] == own or p and [tag(s) for s in b.path[: len(own)]] == [tag(s) for s in own] for b, p in zip(found, prose, strict=True)]
    kept = [i for i in range(len(found)) if inside[i] or prose[i] and level[i] >= bar]
    if not kept:
        return ""
    first = kept[0]
    for i in range(first - 1, -1, -1):
        if not prose[i]:
            break
        if any(re.fullmatch("h[1-6]", tag(s)) for s in found[i].path):
            first = i
    some = [found[i] for i in range(first, kept[-1] + 1) if inside[i] or prose[i]]
    many, all_chars, all_links = (defaultdict(float) for _ in range(3))
    for b in some:
        many[b.path] += 1
        all_chars[b.path] += len("".join(b.text.split()))
        all_links[b.path] += b.link_chars
    return "\n".join(b.text for b in some if not (many[b.path] >= 3 and all_links[b.path] >= 0.8 * all_chars[b.path]))


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.35 and depth < 7:
            tag = rng.choice(["div", "section", "article", "table", "tr", "td", "ul", "li", "main", "span"])
            name = rng.choice(["", "", " class=c1", " class='c2 entry'", " id=body", " class=wide"])
            out.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
        elif kind < 0.5:
            out.append(f"<h2>Heading {rng.randrange(99)}</h2>")
        elif kind < 0.65:
            out.append("".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(rng.randrange(1, 5))))
        else:
            out.append("<p>" + " ".join(rng.choices(["word", "longer,", "sentence.", "a", "text", "<a href=x>go</a>"], k=rng.randrange(1, 40))) + "</p>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_text_by_path_nodes_equals_whole_paths(seed):
    page = random_page(random.Random(seed))
    found = blocks(page)
    assert main_text(page) == naive_text([b for b in found if not b.boilerplate])


@pytest.mark.parametrize("name", ["c", "sidebar"])
def test_deep_pages_take_time_in_proportion(name):
    began = time.process_time()
    page = "".join(f"<div class={name}>text {i}, with words." for i in range(10_000)) + "</div>" * 10_000
    assert main_text(page).count("\n") == 9_999
    assert time.process_time() - began < 20


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "iframe"])
def test_raw_text_has_no_empty_form(tag):
    assert main_text(f'<article><p>One, two.</p><{tag} src="a.js" />var leaked = 1;</{tag}><p>Three.</p></article>') == "One, two.\nThree."
    assert main_text(f"<article><p>One, two.</p><{tag}/><p>Three.</p></article>") == "One, two.\nThree."


def test_an_articles_own_header_stays():
    page = f'<div class="site-header"><p>Site, name.</p></div><article><div class="post-header"><h1>Title</h1></div>{LONG}<div class="post-comments"><p>Rude, very.</p></div></article>'
    got = main_text(page).split("\n")
    assert got[0] == "Title" and len(got) == 21


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("<script>x", ""), ("a < b and c<d>e", "a < b and c\ne"), ("<p>x</p></p></div><p>y", "x\ny"), ("<nav>only menu</nav>", ""), ('<p title="a>b">q</p>', "q"), ('<p title="open>q</p>', "q"), ("<!-- never closed <p>x", "")],
)
def test_broken_pages(page, want):
    assert main_text(page) == want


def test_every_row_and_very_long_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i}, text.</p>" for i in range(20000)) + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", long, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 3)["text"].count("\n") == 19999
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ratios_and_smoothing():
    found = blocks("<div><p>One, two.</p><p>Three.</p></div><ul><li><a href=x>go</a></li></ul>")
    r = path_ratios(found)
    r = {node.path: x for node, x in r.items()}
    assert r[("div", "p")] > r[("ul", "li")] == 0
    assert smooth([0, 4, 0]) == [1.0, 2.0, 1.0] and smooth([]) == []
    assert Counter(b.path for b in found) == Counter({("div", "p"): 2, ("ul", "li"): 1})
