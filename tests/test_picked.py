"""Cells that are picked where a page is read agree with column expressions over its elements."""

import pyarrow as pa
from pyspark.sql import functions as F

from courtline.operators import ingest
from courtline.operators import pages as p

PAGE = """<title> A
 b</title><span class="game-time x status-detail">Final&nbsp;/ OT</span><span class="game-time status-detail">no</span>
<div class="team home away"><A CLASS='team-name' HREF="/h?a=1&amp;b" href=z>q</a><div class=score>7 \t8</div></div>
<p class="sub-module"><div class="sub-module"><table><tr class="highlight"><td class="fg 3pt">1<table><tr><td class=ft>2</table><td class=fg>9
<tr class=highlight><td class=pts>4</table></div><i class="x sub-module"><b><tr class="highlight"><td class="pts to">5 <b>6</b></i>"""
PAGES = [PAGE, None, "", "x", "<td class=fg>1", PAGE.replace("away", "").replace("<title>", "<title><b>"), "<!-- " * 40, PAGE + "<", PAGE * 2 + "< b>"]


def test_cells_equal_column_expressions(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "game_id int, html string")
    got = ingest.box_score_cells(pages)
    read = p.with_elements(pages)
    want = {"title": p.text_of(p.first(p.select(tag="title"))), "status_text": p.text_of(p.first(p.select(tag="span", classes=ingest.GAME_STATUS)))}
    for side in ("away", "home"):
        read = read.withColumn(f"{side}_block", p.first(p.select(tag="div", classes=("team", side))))
        within = lambda tag, label, side=side: p.first(p.select(tag=tag, classes=(label,), inside=F.col(f"{side}_block")))
        want |= {f"{side}_href": within("a", "team-name")["attributes"]["href"], f"{side}_score": p.text_of(within("div", "score"))}
    for at, side in enumerate(("away", "home")):
        read = read.withColumn(f"{side}_section", p.first(p.select(classes=("sub-module",)), at))
        read = read.withColumn(f"{side}_totals", p.first(p.select(tag="tr", classes=("highlight",), inside=F.col(f"{side}_section"))))
        for column, label in ingest.CELL_CLASSES.items():
            want[f"{side}_{column}"] = p.text_of(p.first(p.select(tag="td", classes=(label,), inside=F.col(f"{side}_totals"))))
    want = read.select("game_id", *[e.alias(c) for c, e in want.items()])
    assert sorted(got.columns) == sorted(want.columns)
    rows = {r.game_id: r.asDict() for r in want.collect()}
    assert {r.game_id: r.asDict() for r in got.collect()} == rows
    assert rows[0]["away_score"] == "7 8" and rows[0]["away_href"] == "/h?a=1&b" and rows[1]["title"] is None


def test_no_element_leaves_the_worker(spark):
    pages = spark.createDataFrame([(1, PAGE)], "game_id int, html string")
    plan = ingest.box_score_cells(pages)._jdf.queryExecution().executedPlan().toString()
    assert "elements" not in plan and "attributes" not in plan


def test_attributes_met_before_are_not_shared():
    one, two = p.read_page("<b class='x y'>"), p.read_page("<b class='x y'>")
    one["elements"][0]["classes"].append("z")
    assert two["elements"][0]["classes"] == ["x", "y"] and pa.array([one, two], p._PAGE)[1]["elements"][0]["size"].as_py() == 0
