"""Spans of table cells against a place-by-place fill, and hostile ones in time."""

import random
import time

from caseloom.functions import fields


def slow(page):
    parser, taken, out, rows = fields._Tables(), set(), [], {}
    parser.feed(page)
    for table, row, *_ in parser.cells:
        rows[table] = max(rows.get(table, 0), row + 1)
    for table, row, down, across, text in parser.cells:
        column = 0
        while (table, row, column) in taken:
            column += 1
        for r in range(row, min(row + down, rows[table])):
            for c in range(column, column + min(across, fields.MOST_COLUMNS)):
                if (table, r, c) not in taken:
                    taken.add((table, r, c))
                    out.append((table, r, c, " ".join(text.split())))
    return sorted(out)


def test_spans_fill_the_same_places():
    rnd = random.Random(1)
    cell = lambda: f"<td rowspan={rnd.choice([1, 1, 2, 3, 9])} colspan={rnd.choice([1, 1, 2, 3])}>{rnd.randint(0, 99)}</td>"
    for _ in range(1500):
        page = "".join("<table>" + "".join("<tr>" + "".join(cell() for _ in range(rnd.randint(0, 4))) + "</tr>" for _ in range(rnd.randint(0, 5))) + "</table>" for _ in range(2))
        assert fields.grid_cells(page) == slow(page)


def test_plain_pages_are_read_without_a_parser():
    rnd, plain = random.Random(2), 0
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th rowspan=2>", "<td colspan=3>", "<td rowspan=0>", "</th>", "<p>", "</p>", "a", " b\n", "1 > 0", "&amp;", "&lt;b", "&#65;", "&#0065;"]
    odd = ["<TD>", "<td class=x>", "<td rowspan='2'>", "<!-- <td> -->", "&", "&copy", "<br>", "< td>", "<td", "<script><td></script>", "&#x41;", "<td rowspan=999999>"]
    for i in range(4000):
        page = "<table><tr>" + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) + (rnd.choice(odd) if i % 4 == 0 else "") + rnd.choice(["", "end", "&amp;"])
        parser, told = fields._Tables(), fields.plain_cells(page)
        parser.feed(page)
        assert told is None or told == parser.cells
        assert (told is None) == (i % 4 == 0)
        plain += told is not None
    assert plain == 3000 and fields.plain_cells("") is None
    began, page = time.time(), "<table>" + "<tr><td>x</td><td> &amp; </td></tr>" * 100_000 + "</table>"
    assert len(fields.plain_cells(page)) == 200_000 and time.time() - began < 2


def test_hostile_spans_end_soon():
    began = time.time()
    page = "<table><tr><td rowspan=65000 colspan=65000>x</td></tr><tr><td>y</td></tr></table>"
    cells = fields.grid_cells(page)
    assert len(cells) == 2 * fields.MOST_COLUMNS + 1 and cells[-1] == (0, 1, fields.MOST_COLUMNS, "y") and time.time() - began < 2
    assert fields.grid_cells(None) == fields.grid_cells("") == []
