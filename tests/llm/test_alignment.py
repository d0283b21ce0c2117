"""Alignment of child lists of any length."""

from __future__ import annotations

import random

from tailward.llm import html


def test_long_lists_are_aligned_like_short_ones():
    for rows in (20, 250):
        body = "".join(f"<p><b>row {k}</b></p>" for k in range(rows))
        got = html.slots(f"<div>{body}<ul><li>end</li></ul></div>", f"<div><h3>more</h3>{body}<dl><dt>end</dt></dl></div>")
        assert [b["ref"] >= 0 for b in got] == [True] * rows + [False]


def test_alignment_in_blocks_of_rows_equals_the_whole_table():
    rng = random.Random(5)
    kinds = [html.shape(html.parse(f"<div>{body}</div>")[0]) for body in ("", "a", "<p>a</p>", "<p>a</p>b", "<b>a</b>", "<p>a</p><p>b</p>", "<i>a</i>b<b>c</b>")]
    for _ in range(60):
        x, y = ([rng.choice(kinds) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        table = [[0] * (len(y) + 1)]
        for i in x:
            row = [0]
            for k, j in enumerate(y):
                row.append(max(table[-1][k + 1], row[-1], table[-1][k] + html.matching(i, j)))
            table.append(row)
        i, j, places = len(x), len(y), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                places.append((i, j))
        assert html._matched_places(x, y) == places
