import numpy as np
from brute_texts import article
from conftest import SF

from callscope.llm import boost, html_text


def text_of(source):
    return html_text.main_texts([source], html_text.model())[0]


def test_pages_against_plain_reading(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert all(got[r.page_id].text == article(r.html) for r in rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_held_out_layouts():
    layout, wrong, total = html_text.Layout(4321), 0, 0
    for _ in range(150):
        rows, labels = html_text._labelled(layout.page())
        wrong += int(((html_text.model().log_odds(rows) > 0) != labels).sum())
        total += len(labels)
    assert wrong / total < 0.01


def test_other_markup():
    page = """<body><div id=cookie-banner><p>We use cookies on this site, read about them here.</p></div>
    <header class=top>Site name</header><div class="sidebar"><h3>Related</h3><p>Some other story you may like here.</p></div>
    <div class="entry-content"><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b>
    words and a&nbsp;space.<p>Second one, which is a little longer than the first one was. And it goes on.
    <ul><li>point one<li>point two</ul><div class="advert">Buy this now and save a lot of money.</div>
    <p>Last words of the story come here, at the end of it all.</p></div>
    <section class=comments><div class=comment><p>I liked reading this story very much.</p></div></section>
    <form><label>Mail</label><input></form><footer>&copy; 2024 Somebody</footer>"""
    assert text_of(page) == (
        "A title & more\nFirst paragraph with bold words and a space.\nSecond one, which is a little longer than the "
        "first one was. And it goes on.\npoint one\npoint two\nLast words of the story come here, at the end of it all."
    )


def test_states_never_contradict():
    layout, trees = html_text.Layout(7), html_text.model()
    for _ in range(40):
        page = html_text.Page(layout.page())
        picked, rows = html_text.features(page)
        inside = html_text.decode(page, picked, np.random.default_rng(1).normal(0, 3, len(picked)) + trees.log_odds(rows))
        for node, parent in enumerate(page.parents):
            if node and not inside[parent] and inside[node]:
                above = parent
                while above > 0:  # what holds an article is undecided, never itself inside above that
                    above = page.parents[above]
                    assert not inside[above]


def test_odd_pages(spark):
    sources = [None, "", "plain words only", "<p", "<<<>>>", "<div>" * 3000 + "deep", "<script>x</script>", "</p></div>", '<a "' * 2000,
               "<article><p>" + "Words of a long text. " * 20000 + "</article>"]
    rows = [(k if k % 2 else None, s, None, "c", 1) for k, s in enumerate(sources)] + [(1, "", None, "c", 1)]
    frame = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars int")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == len("Words of a long text. " * 20000) - 1
    assert html_text.extract(frame.limit(0)).count() == 0


def test_boosted_trees_learn_an_interaction():
    x = np.random.default_rng(5).normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost.Trees().fit(x[:2000], y[:2000])
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_long_attribute_values():
    for size in (3_000, 5_000, 1_000_000):
        for value in ("A" * size, "A>" * (size // 2)):
            for quote in "\"'":
                page = (f"<article><p>One first paragraph of the story.</p><img src={quote}data:image/png;base64,{value}{quote}>"
                        '<p>A second one with <a href="/l">a link</a> in it.</p><p class="x">The last one of them.</p></article>')
                assert html_text.Page(page).blocks == [
                    (2, "One first paragraph of the story."), (3, "A second one with a link in it."), (5, "The last one of them.")
                ]


def test_quotes_that_open_no_value():
    blocks = lambda source: [text for _, text in html_text.Page(source).blocks]
    assert blocks("<p title=it's>It's one.</p><p class=\"a\">It's two.</p>") == ["It's one.", "It's two."]
    assert blocks('<p title="lone>One.</p><p>Two.</p>') == ["One.", "Two."]
    assert blocks('<p class="a"id="b>c"data-x = \'d>e\'>One.</p>') == ["One."]
    for part in ('<a "', '<a x="', "<a x='", '<a x="<a y=\'', "<a ", "<a x=>"[:-1]):
        for tail in ("", '">"'):
            html_text.Page(part * 20_000 + tail)


def test_visible_content_is_left_to_the_trees():
    long = "and it goes on for a while, so that it reads like the text of a story."
    page = (f"<article><h1>A title of the story</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, {long}</p>"
            f"<p>See <canvas>a chart of it</canvas> here, {long}</p><p>A <button>folded</button> word, {long}</p>"
            f"<object data=a><object data=b><p>An outer and an inner fallback, {long}</p></object>"
            f"<p>The rest of the outer one, {long}</p></object><p>The end, {long}</p></article>")
    assert text_of(page) == "\n".join([
        "A title of the story", f"Let x=2 hold, {long}", f"See a chart of it here, {long}", f"A folded word, {long}",
        f"An outer and an inner fallback, {long}", f"The rest of the outer one, {long}", f"The end, {long}",
    ])


def test_skipped_content_ends_at_its_own_end_tag():
    blocks = lambda source: [text for _, text in html_text.Page(source).blocks]
    assert blocks("<p>a <svg><svg><text>in</text></svg><!-- </svg> --><svg/><text>out</text></svg> b</p>") == ["a b"]
    assert blocks("<p>a <svg/> b</p><svg></svg>") == ["a b"]
    assert blocks("<template><template>in</template>out</template><p>b</p>") == ["b"]
    assert blocks("<p>a <svg><svg></svg> b</p>") == ["a b"]
    assert blocks("<p><math><semantics><mi>x</mi><annotation>x^{2}</annotation></semantics></math></p>") == ["x"]
    html_text.Page("<svg>" * 20_000)
