import pytest

from siltstone.operators import tables


def plain(page):
    return [[" ".join(f"{row[c][0]}{'' if row[c][1] else '*'}" for c in sorted(row)) for row in grid] for grid in tables.grids(page)]


CASES = {
    "<table><tr><th>a<th>b<tr><td>1<td>2</table>": [["a b", "1 2"]],
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": [["a b", "a* c", "d e"]],
    "<table><tr><td colspan=2>a<td>b<tr><td>c<td rowspan=3>d<td>e<tr><td>f<td>g</table>": [["a a* b", "c d e", "f d* g"]],
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>": [["a b", "a* c", "d e"]],
    "<table><td>no row<td>x</table>": [["no row x"]],
    "<table><tr><td>out<table><tr><td>in</table>side<td>b</table>": [["outside b"], ["in"]],
    "<table><tr><td>open <b>cell": [["open cell"]],
    "<table><tr><td>a<script>no()</script><br>b &amp; c</table>": [["a b & c"]],
    "<td>no table</td>": [],
    "<table></table>": [],
    "<table><tr><td colspan=x rowspan=-1>a</table>": [["a"]],
}


@pytest.mark.parametrize("page", CASES)
def test_grids(page):
    assert plain(page) == CASES[page]


def test_financial():
    sheet = lambda head, *rows: tables.grids("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in (head, *rows)) + "</table>")[0]
    assert tables.is_financial(sheet(("Particulars", "x"), ("a", "b"), ("c", "d")))
    assert tables.is_financial(sheet(("x", "y"), ("a", "b"), ("c", "d"), ("e", "4")))
    assert not tables.is_financial(sheet(("x", "y"), ("a", "b"), ("c", "d"), ("e", "f"), ("g", "4")))
    assert not tables.is_financial(sheet(("Total",), ("1",), ("2",))) and not tables.is_financial(sheet(("Total", "x"), ("1", "2")))


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>x"), (4, "<table><tr><td>a<td>b</table>"), (4, "<table><tr><td>a<td>b</table>")]
    got = sorted(tuple(r) for r in tables.cells(spark.createDataFrame(rows, "page_id long, html string")).collect())
    assert got == sorted([(4, 0, 0, 0, "a", True, False), (4, 0, 0, 1, "b", True, False)] * 2)
