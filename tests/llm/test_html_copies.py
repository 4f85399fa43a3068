"""Copies of pages are no template."""

from loomline.llm import html_template


def texts(spark, rows):
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


def test_copies_keep_their_text(spark):
    page = "<div class=nav>Page {1}</div><div class=top>Acme</div><div class=z><h2>Head {0}</h2><p>Story {0}</p></div>"
    same = [(i, "https://a.org/x", page.format(1, 1)) for i in range(3)]
    around = [(10 + i, "https://b.org/x", page.format(1, i)) for i in range(4)]
    half = [(20 + i, f"https://c.org/{i}", page.format(max(0, i - 5), 1)) for i in range(12)]
    unplaced = [(40 + i, None, "<p>one text</p>") for i in range(5)]
    got = texts(spark, same + around + half + unplaced)
    assert {got[i] for i in range(3)} == {got[10 + i] for i in range(4)} == {"Acme\n\nHead 1\n\nStory 1"}
    assert all(got[20 + i] == f"Head {max(0, i - 5)}\n\nStory {max(0, i - 5)}" for i in range(12))
    assert {got[40 + i] for i in range(5)} == {"one text"}


def test_shared_text_goes_at_any_length(spark):
    """A legal text repeated, long, or of many paragraphs; headings differ, or the text is one block however often."""
    legal = "This site and all that is on it belong to somebody. "
    many = "".join(f"<p>Clause {k} of the terms of this site</p>" for k in range(60))
    bodies = [f"<p>{legal}</p>" * 3, f"<p>{legal}</p>" * 10, f"<p>{legal * 200}</p>"]
    rows = [(100 * n + i, f"https://{n}.org/{i}", f"<div class=z><p>Story {i} is told here</p><p>And part {i * 7} of it</p><div class=legal>{b}</div></div>") for n, b in enumerate(bodies) for i in range(8)]
    rows += [(900 + i, f"https://many.org/{i}", f"<div class=z><h2>Head {i}</h2><p>Story {i}</p>{many}</div>") for i in range(8)]
    got = texts(spark, rows)
    assert all(got[100 * n + i] == f"Story {i} is told here\n\nAnd part {i * 7} of it" for n in range(3) for i in range(8))
    assert all(got[900 + i] == f"Head {i}\n\nStory {i}" for i in range(8))


def test_near_copies_keep_their_text(spark):
    """One article with an edit each, headings and all; long or short paragraphs, repeated or not."""
    for size in (1, 40):
        page = "<div class=z><h2>One head</h2>" + "".join(f"<p>{f'Paragraph {k} of it. ' * size}</p>" for k in range(12)) + "<p>Edit {}</p></div>"
        got = texts(spark, [(i, f"https://near.org/{i}", page.format(i)) for i in range(6)])
        assert all(got[i].startswith("One head\n\nParagraph 0 of it.") and got[i].count("\n\n") == 13 and got[i].endswith(f"Edit {i}") for i in range(6))
