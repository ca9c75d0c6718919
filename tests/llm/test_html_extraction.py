import random
import re
from html import unescape

import pytest
from odd_rows import with_clashes
from pyspark.sql import functions as F

from receivables.llm import html_extraction as H
from receivables.llm import queries

ARTICLE = "<p>First, a sentence with words, and more of them.</p><p>Second one, as long as the first, or so.</p>"

# page, its main text
CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("plain text", "plain text"),
    ("a < b &amp; c", "a < b & c"),
    ("<p>cut off", "cut off"),
    ('<p>cut <a href="x', "cut"),
    ("<p>un<b>bro</b>ken w&ouml;rd&#33;</p>", "unbroken wörd!"),
    ("<p>a\n\t b&nbsp;c<br>d</p>", "a b c d"),
    ("<script>var a = '</p>';</script><p>x</p>", "x"),
    ("<style>p{}</style><!-- <p>no</p> --><p>x</p>", "x"),
    ("<p>x</p><script>never closed <p>y</p>", "x"),
    ("<nav>menu</nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T x"),
    ("<article><p><b>one<br><p>two</p></article><div class='ad'>buy</div>", "one two"),
    (f"<div class=menu>{ARTICLE}</div><main>short</main>", "short"),
    ("<article>a<ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article>", "a b c d e"),
    (
        f"<body><header>h</header><div id=post class='with-sidebar'><h2>T</h2>{ARTICLE}</div>"
        "<aside>s</aside><form>f<input></form><div class='comments'><p>No, no.</p></div></body>",
        "T First, a sentence with words, and more of them. Second one, as long as the first, or so.",
    ),
    ("<article><p>x</p><section class='reader-comments'><p>y</p></section></article>", "x"),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T x"),
    ("<P>Upper</P><DIV CLASS=\"Cookie-Notice\">c</DIV>", "Upper"),
    ("</p></div>x</b>", "x"),
    ("<p>a</p><p></p><p> </p><p>b</p>", "a b"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert H.extract(page) == text


STORY = "First, a sentence with words, and more of them. Second one, as long as the first, or so."
COMMENTS = "".join(f"<li><p>I do not think so, not at all, and say it at length. Number {i}.</p></li>" for i in range(9))


@pytest.mark.parametrize("around", ["<form id=aspnetForm>{}</form>", "<div role=form>{}</div>", "<fieldset>{}</fieldset>"])
def test_a_form_around_the_page_is_kept_without_its_controls(around):
    page = f"<input><div>{ARTICLE}</div><button>Go on.</button><label>Name.</label>"
    assert H.extract(f"<body>{around.format(page)}</body>") == STORY
    small = around.format("Search, if you like.<input>")
    assert H.extract(f"<body>{small}<div>{ARTICLE}</div>{small}</body>") == STORY


@pytest.mark.parametrize("tag", ['<div class="x"">', "<div class='x''>", '<div "x">', '<div a=b" c>', "<div it's>"])
def test_stray_quotes_in_a_tag(tag):
    assert H.extract(f'{tag}{ARTICLE}</div><a href="y">z</a>') .startswith(STORY)
    assert H.extract(f'<div title="a > b" data-x = \'>\'>{ARTICLE}</div>') == STORY


@pytest.mark.parametrize(
    "part",
    [
        '<div id="comments" class="comments-area"><ul>{}</ul></div>',
        '<ol class="commentlist">{}</ol>',
        '<section class="discussion">{}</section>',
        '<div id="respond">{}</div>',
        '<div class="replies">{}</div>',
    ],
)
def test_comments_that_outweigh_the_story(part):
    comments = part.format(COMMENTS)
    assert H.extract(f"<body><div>{ARTICLE}</div>{comments}</body>") == STORY
    assert H.extract(f"<body><article>{ARTICLE}{comments}</article></body>") == STORY
    alone = H.extract(f"<body><nav>Menu.</nav>{comments}</body>")  # the page has nothing else
    assert alone.count("Number") == 9


def test_formulas_and_footers_of_quotes():
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>"
    assert H.extract(f"<article><p>Let {formula} hold.</p></article>") == "Let x=1 hold."
    quote = "<blockquote><p>To be.</p><footer>Hamlet</footer></blockquote>"
    assert H.extract(f"<article>{ARTICLE}{quote}</article><footer>f</footer>") == f"{STORY} To be. Hamlet"


def test_paths_are_told_apart_however_deep():
    deep = "<div>" * 40 + "<p>{}</p>" + "</div>" * 40
    page = f"<section>{deep.format('a')}</section><main>{deep.format('b')}</main>"
    assert [path[0] for path, _ in H.blocks(page)] == ["section", "main"]
    assert {len(path) for path, _ in H.blocks(page)} == {42}


def test_ratios_by_sums_over_spelt_paths():
    """Brute force: every block's path spelt out, its text and punctuation summed up anew."""
    rng = random.Random(8)
    for _ in range(60):
        page, open_ = "", []
        for _ in range(rng.randrange(5, 60)):
            if rng.random() < 0.5:
                open_.append(rng.choice(["div", "section", "p", "ul", "li", "article", "blockquote"]))
                page += f"<{open_[-1]}>"
            elif open_ and rng.random() < 0.5:
                page += f"</{open_.pop()}>"
            else:
                page += rng.choice(["One, two. ", "three ", "<b>four!</b> ", "five; six, seven. "]) * rng.randrange(1, 9)
        paths, _, kept = H.parts(page)
        sums = {}
        for block, text in kept:
            n, marks = sums.get(block.path, (0, 0))
            sums[block.path] = n + len(text), marks + len(re.findall("[.,;:!?]", text))
        found = {paths.spelt(path): ratio for path, ratio in H._ratios(sums).items()} if sums else {}
        spelt = [path for path, _ in H.blocks(page)]
        texts = [text for _, text in H.blocks(page)]
        best, expected = 0, {}
        for path in set(spelt):
            own = [t for p, t in zip(spelt, texts) if p == path]
            expected[path] = sum(map(len, own)), sum(len(re.findall("[.,;:!?]", t)) for t in own)
        longest = max((n for n, _ in expected.values()), default=1)
        most = max(1, max((m for _, m in expected.values()), default=1))
        fused = {path: n / longest + m / most for path, (n, m) in expected.items()}
        best = max(fused.values(), default=1)
        assert found == pytest.approx({path: value / best for path, value in fused.items()})


def test_deep_and_long_pages():
    assert H.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    text = "word, and more. " * 50_000
    assert H.extract(f"<p>{text}</p>") == text.strip()
    assert H.extract("<" * 20_000 + "a") != None  # noqa: E711
    assert H.extract("<b>" * 20_000 + "x") == "x"


def test_threshold_leaves_out_short_paths():
    page = f"<div><div>{ARTICLE * 10}</div></div><ul><li>x</li></ul>"
    assert H.extract(page).endswith("or so.")
    assert {path for path, _ in H.blocks(page)} == {("div", "div", "p"), ("ul", "li")}


SHOWN = [
    'class="overflow-hidden post"', 'style="overflow: hidden"', 'aria-hidden="false"', 'title="A hidden valley"',
    'data-id="menu"', 'hidden="until-found"', "data-hidden", 'style="display:none;display:block"', 'title="id=menu"',
]
HIDDEN = [
    "hidden", "HIDDEN=''", 'hidden="hidden"', "aria-hidden=true", "aria-hidden='TRUE'", 'style="color:red; Display : NONE"',
    'style="visibility:hidden!important;visibility:visible"', 'style="display:none',
]


def test_only_hidden_elements_are_left_out():
    for attributes in SHOWN:
        assert H.extract(f"<div {attributes}>{ARTICLE}</div><p>x</p>").startswith("First, a"), attributes
        assert H.extract(f"<p>a <span {attributes}>b</span> c</p>") == "a b c", attributes
    assert H.extract('<p>see <a href="/hidden-gems">the gems</a>.</p>') == "see the gems."
    for attributes in HIDDEN[:-1]:
        assert H.extract(f"<p>a <span {attributes}>b</span> c</p>") == "a c", attributes
    assert H.extract(f"<p>a <span {HIDDEN[-1]}>b</span> c</p>") == "a"


WRAPPERS = ["page sidebar-left", "layout sidebar-right", "has_sidebar", "menu-open", "content with-nav", "sidebar"]


def test_names_do_not_leave_out_most_of_a_page():
    text = H.extract(ARTICLE)
    for name in WRAPPERS:
        page = f"<div class='{name}'>{ARTICLE * 3}<div class=sidebar><p>s, s.</p></div></div><div id=ad>buy</div>"
        assert H.extract(page) == " ".join([text] * 3), name
    widgets = "".join(f"<div class='elementor-widget'><p>Part {i}, with a sentence.</p></div>" for i in range(9))
    assert H.extract(f"<body>{widgets}</body>").count("sentence.") == 9


def test_sections_named_after_their_subject_stay():
    for name in ("social-impact", "related-work"):
        page = f"<article>{ARTICLE * 3}<section class={name}><p>Of this, more.</p></section></article>"
        assert H.extract(page).endswith("Of this, more."), name
    for name in ("social-links", "related posts", "menu-1", "post-comments", "cookie_notice"):
        page = f"<article>{ARTICLE * 3}<section class='{name}'><p><a href=x>Of this, more.</a></p></section></article>"
        assert H.extract(page).endswith("or so."), name


def test_marked_articles_are_a_bonus():
    cards = "".join(f"<article class=card><h2>Card {i}</h2><p>Teaser, short.</p></article>" for i in range(3))
    text = H.extract(f"<body><div class=story>{ARTICLE * 5}</div>{cards}</body>")
    assert H.extract(ARTICLE * 5) in text
    links = "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(3))
    article = f"<h1><a href=/>T</a></h1>{ARTICLE * 5}<ol><li>kept <a href=x>one</a><li>kept two</ol>"
    text = H.extract(f"<div>Outside.</div><article>{article}<ul>{links}</ul></article>")
    assert text == "T " + H.extract(ARTICLE * 5) + " kept one kept two"
    assert H.extract(f"<article><p>a</p></article><div>{'b ' * 900}</div>").startswith("a b")
    assert H.extract(f"<ul>{links}</ul>").endswith("Other story 2")


PARTS = [
    "<ul><li>A list of forty characters, or so</ul>", "<blockquote><p>Quoted.</p></blockquote>",
    "<table><tr><td>a<td>1</table>", "<section><h3>More</h3><div>words</div></section>", "<pre>code</pre>",
]


@pytest.mark.parametrize("part", PARTS)
def test_lists_quotes_and_tables_beside_content(part):
    main, words = H.extract(ARTICLE * 15), H.extract(part)
    for page in (
        f"<div>{ARTICLE * 15}{part}</div>",
        f"<body><div id=a><div>{ARTICLE * 15}{part}</div></div><div><ul><li>x</ul></div></body>",
        f"<article><div>{ARTICLE * 15}</div>{part}</article>",
    ):
        assert H.extract(page) == f"{main} {words}", page
    half = H.extract(ARTICLE * 8)
    page = f"<body><div><div>{ARTICLE * 8}</div><div>{part}</div><div>{ARTICLE * 8}</div></div><ul><li>x</ul></body>"
    assert H.extract(page).startswith(f"{half} {words} {half}")


def test_lists_beside_content_in_the_body():
    page = f"<body>{ARTICLE * 15}<ul><li>kept</ul><div><ul><li>not kept</ul></div></body>"
    assert H.extract(page) == H.extract(ARTICLE * 15) + " kept"


def test_query_against_the_marked_articles(spark):
    sf_dir = "/root/testdata/sf0.01"
    result = queries.op8_html_extraction(spark, sf_dir)
    assert result.columns == ["page_id", "url", "text", "n_chars"]
    found = {row.page_id: row for row in result.collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inside = re.search("<article>(.*?)</article>", page.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
        texts = [" ".join(unescape(re.sub("<[^>]+>", "", part)).split()) for part in parts]
        expected = " ".join(text for text in texts if text)
        row = found[page.page_id]
        assert (row.text, row.n_chars, row.url) == (expected, len(expected), page.url)


def test_odd_tables(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = H.main_text(with_clashes(pages).withColumn("text", F.lit("clash"))).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, None, "", 0)], key=repr
    )
    assert H.main_text(pages.limit(0)).count() == 0
