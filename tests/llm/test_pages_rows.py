"""Pages in the middle of long rows of near copies are differenced against the pages beyond them, however far."""

from quantspark.llm import pages as pg


def test_long_rows_of_copies_keep_their_neighbours(spark):
    article = "<p>" + "The same long article that stands on many pages of this host. " * 10 + "</p>"
    rows = []
    for i in range(90):
        text = article if 5 <= i < 85 else f"<p>{f'Story {i} of its own, with other words than others have. ' * 10}</p>"
        rows.append((i, f"http://h/{i:03d}", f"<div>All rights reserved by us</div>{text}<p>Page {i}.</p>"))
    want = {i: ("The same long" if 5 <= i < 85 else f"Story {i}") for i, _, _ in rows}
    for cfg in (pg.PagesConfig(), pg.PagesConfig(block=16, reach=4)):
        got = {r.page_id: r.text for r in pg.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), cfg).collect()}
        assert len(got) == 90
        assert [i for i in got if not got[i].startswith(want[i])] == []
        assert [i for i in got if "All rights" in got[i] or not got[i].endswith(f"Page {i}.")] == []
