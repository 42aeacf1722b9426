from tidegraph.llm import html


def test_every_page_is_differenced_and_its_marks_are_the_check(spark):
    """Marked pages too are aligned with their nearest page; an unmarked one loses what its marked neighbour has outside its article."""
    page = "<p>Slogan</p><article><p>{}</p><p>License</p></article><p>Legal</p>"
    rows = [(1, "http://h/a/1", page.format("first")), (2, "http://h/a/2", page.format("second")), (3, "http://g/b/1", page.format("third")), (4, "http://g/b/2", "<p>Slogan</p><p>open</p><p>Legal</p>"), (5, "http://lone/", page.format("alone"))]
    got = {r.page_id: (r.text, r.n_shared, r.n_restored) for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("first\nLicense", 3, 1) and got[2] == ("second\nLicense", 3, 1)
    assert got[3] == ("third\nLicense", 2, 0) and got[4] == ("open", 2, 0)
    assert got[5] == ("alone\nLicense", 0, 0)
