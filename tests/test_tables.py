"""HTML tables to pipe tables."""

import pytest
from pyspark.sql import functions as F

from folioquery.functions.tables import grid, pipe_table, replace_tables
from folioquery.functions.text import html_to_markdown


def lines(source):
    return [x for x in pipe_table(source).split("\n") if x]


def test_cells_are_kept_apart():
    assert lines("<table><tr><td>1</td><td>2</td></tr><tr><td>3<td>4</table>") == ["| 1 | 2 |", "|---|---|", "| 3 | 4 |"]


def test_spans_fill_the_grid():
    source = ("<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>b1</th><th>b2</th></tr>"
              "<tr><td rowspan=0>all</td><td>1</td><td>2</td></tr><tr><td colspan=2>wide</td></tr><tr><td>3</td></tr></table>")
    assert lines(source) == ["| A | B b1 | B b2 |", "|---|---|---|", "| all | 1 | 2 |", "| all | wide | wide |", "| all | 3 |  |"]


def test_a_span_goes_round_what_is_taken():
    """A cell below two hanging ones takes the first free place; a wide one may reach over a hanging one."""
    source = "<table><tr><td>a</td><td rowspan=3>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td colspan=3>f</td></tr></table>"
    assert lines(source)[2:] == ["| d | b | e |", "| f | b | f |"]


@pytest.mark.parametrize("source, want", [
    ("<table></table>", []),
    ("<table><tr></tr><tr><td> </td></tr></table>", []),
    ("<table><caption>Table 3: <i>Things</i></caption><tr><td>x</td></tr></table>", ["**Table 3: Things**", "| x |", "|---|"]),
    ("<table><tr><td>a|b</td><td>c<br>d<p>e</p></td></tr></table>", ["| a/b | c d e |", "|---|---|"]),
    ("<TABLE><TR><TD colspan='x' rowspan=-1>&lt;q&gt; &#39;</TD></TR></TABLE>", ["| &lt;q&gt; &#39; |", "|---|"]),
    ("<table><td>no row</td></table>", ["| no row |", "|---|"]),
    ("<table><tr><td>in <table><tr><td>1</td><td>2</td></tr></table> out</td><td>z</td></tr></table>", ["| in 1 2 out | z |", "|---|---|"]),
])
def test_odd_tables(source, want):
    assert lines(source) == want


def test_grid_is_a_rectangle():
    cell = lambda t, c=1, r=1: [[t], c, r, False]
    rows = [[cell("a", 2, 2)], [cell("b")], [], [cell("c"), cell("d"), cell("e"), cell("f")]]
    got = [[t for t, _ in line] for line in grid(rows)]
    assert got == [["a", "a", "", ""], ["a", "a", "b", ""], ["", "", "", ""], ["c", "d", "e", "f"]]


def test_pages(spark):
    page = ("<h2>Table 1 Costs</h2><p>Intro of the table</p><!-- <table> --><table><tr><th>Name</th><th>Cost</th></tr>"
            "<tr><td>x &amp; y</td><td>1</td></tr></table><p>after</p><table><tr><td>never closed")
    rows = [(1, page), (2, None), (3, "plain"), (4, "</table><table><tr><td>k</td></tr></table>")]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, html string").select("i", html_to_markdown(F.col("html")).alias("v")).collect()}
    assert got[1] == "## Table 1 Costs\n\nIntro of the table\n\n| Name | Cost |\n|---|---|\n| x & y | 1 |\n\nafter\n\nnever closed"
    assert got[2] is None and got[3] == "plain" and got[4] == "| k |\n|---|"
    assert replace_tables("no table") == "no table"
