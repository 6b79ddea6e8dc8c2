import numpy as np

from corpusloom.llm import html_extract
from corpusloom.llm.html_blocks import blocks
from corpusloom.llm.train_labeller import Pages, train


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert texts("<p>a  <b>b</b>\n c<p>d &amp; e&nbsp;f &lt;g&gt;<br>h</p>tail") == ["a b c", "d & e f <g> h", "tail"]
    assert texts("<script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>") == ["a", "b", "c"]
    assert texts("<p title='a>b'>x</p><p>1 < 2 &am</p><p") == ["x", "1 < 2 &am"]
    assert texts(None) == texts("") == texts("<p> </p>") == []
    assert [b.path for b in blocks("<article><p>a<div class='x Y-z'>b</div></article>")] == [("article", "p"), ("article", "div", ".x", ".y", ".z")]


def test_deep_and_long_markup():
    assert texts("<div>" * 5000 + "x" + "</div>" * 5000) == ["x"]
    assert len(texts("<p>a</p>" * 20000)) == 20000


def test_labeller_on_unseen_pages():
    made, net = Pages(991), html_extract.Labeller.load()
    examples = [made.example() for _ in range(300)]
    right = total = 0
    for found, truth in examples:
        keep = net.main(html_extract.vectors([found]), [len(found)]) >= 0.5
        right, total = right + int((keep == (truth > 0.5)).sum()), total + len(truth)
    assert right / total > 0.98


def test_batches_do_not_matter():
    made, net = Pages(5), html_extract.Labeller.load()
    pages = ["".join(m for m, _ in made.page()) for _ in range(12)] + ["", None, "<p>x"]
    assert html_extract.main_text(pages, net) == [html_extract.main_text([p], net)[0] for p in pages]


def test_training_learns():
    _, accuracy = train(pages=250, epochs=4, seed=3)
    assert accuracy > 0.8
    assert np.isfinite(accuracy)


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (2, None, "<article><h1>T</h1><p>One&amp;two.</p></article>", "z")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (2, None, "T\n\nOne&two.", 11)], key=str)
    assert html_extract.extract(df.limit(0)).collect() == []
