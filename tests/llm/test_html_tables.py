"""Tables with open column groups, and dialogs."""

import pytest

from hushframe.llm.html_text import html_text

ROWS = "<tr><td>A<td>B<tr><td>C<td>D</table>end"


@pytest.mark.parametrize("head", ["<colgroup><col><tbody>", "<colgroup><col>", "<colgroup><col><col><colgroup><tbody>", "<colgroup></colgroup><tbody>", "<caption>cap<colgroup><col><tbody>"])
def test_open_column_group(head):
    lines = html_text("<table>" + head + ROWS).split("\n")
    assert [x for x in lines if x and x != "cap"] == ["A  B", "C  D", "end"] and ("cap" in lines) == ("cap" in head)


def test_column_group_before_head_and_foot():
    lines = html_text("<table><colgroup><col><thead><tr><th>H</thead><tfoot><tr><td>F</tfoot><tbody><tr><td>A</table>").split("\n")
    assert sorted(lines) == ["A", "F", "H"]


def test_sections_within_sections_keep_their_rows():
    assert html_text("<table><tbody><tr><td>A</tr><thead><tr><td>B</table>").split("\n") == ["A", "B"]


def test_open_dialogs_are_shown():
    assert html_text("<dialog open>shown</dialog><dialog>closed</dialog>") == "shown"
    assert html_text("<p>a<dialog open><p>b</dialog>") == "a\n\nb"
