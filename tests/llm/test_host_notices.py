"""Notices that a host puts into its marked articles, which only its runs tell from the article."""

from credsift.llm import html_main

NOTICE = "Read more of our stories in the daily letter of the house"


def page(*blocks):
    return "<nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"


def story(i, n=30):
    return " ".join(f"word{i}x{k}" for k in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_notices_in_articles(spark):
    rows = [(i, "http://a/x", page(story(i), NOTICE, story(i + 100))) for i in range(6)]
    rows += [(6 + i, "http://a/x", page(story(50 + i), story(150 + i))) for i in range(4)]
    rows += [(20, "http://a/x", page(f"{story(20)} {NOTICE}", story(21))), (21, "http://b/x", page(story(22), NOTICE, story(23)))]
    got = texts(spark, rows)
    assert [got[i] for i in range(6)] == [f"{story(i)}\n\n{story(i + 100)}" for i in range(6)]
    assert all(got[6 + i] == f"{story(50 + i)}\n\n{story(150 + i)}" for i in range(4))
    assert NOTICE in got[20] and NOTICE in got[21]  # within a block; on another host


def test_copies_of_articles_stay_whole(spark):
    copies = [(i, "http://a/x", page(story(1), story(2), "Edited " * (i + 1) + story(3, 40))) for i in range(8)]
    same = [(10 + i, "http://b/x", page(story(7), story(8))) for i in range(8)]
    few = [(30 + i, "http://c/x", page(story(30 + i), NOTICE, story(40 + i))) for i in range(4)]
    got = texts(spark, copies + same + few)
    assert all(story(1) in got[i] and story(2) in got[i] for i in range(8))
    assert all(got[10 + i] == f"{story(7)}\n\n{story(8)}" for i in range(8))
    assert all(NOTICE in got[30 + i] for i in range(4))
