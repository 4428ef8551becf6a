"""Where labels go on a page, without drawing: sizes and places from callbacks that measure text and find free room."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from hushframe.operators.blocks import label_rows

#: Pixels of the smallest print, and the least room that a label gets.
SMALLEST, LEAST_ROOM = 8, 8
#: Boxes up to this many type heights hold one line of print.
ONE_LINE = 1.6

Box = tuple[int, int, int, int]
#: (advance, box of the ink) of a text at a size.
Extent = Callable[[str, int], tuple[float, tuple[float, float, float, float]]]
#: clear(rows, left, right, colour): the first column from left to right that holds print, or right.
Clear = Callable[[tuple[int, int], int, int, tuple], int]


@dataclass(frozen=True)
class Group:
    """A text group to label: its box, what to write, its sizes, and the colour that it stands on."""

    box: Box
    label: str
    em: int
    tall: int
    colour: tuple = (255, 255, 255)


@dataclass(frozen=True)
class Place:
    """A text's place: y is its base line if `on_line`, else the top of its em box."""

    text: str
    x: float
    y: float
    size: int
    on_line: bool
    colour: tuple


def size_within(text: str, room: float, most: int, extent: Extent) -> int:
    """The largest size, from `most` down to the smallest print, at which text takes no more than the room."""
    return next((s for s in range(most, SMALLEST, -1) if extent(text, s)[0] <= room), min(most, SMALLEST))


def _top(box: Box, ink: tuple) -> float:
    """Where a text begins so that its ink is in the middle of the box's height."""
    spare = box[3] - box[1] - (ink[3] - ink[1])
    return box[1] - ink[1] + max(0, spare // 2)


def label_places(groups: list[Group], width: int, extent: Extent, clear: Clear) -> Iterator[Place]:
    """The groups' labels, row by row from the left, on a page of that width.

    A label begins where its group does, or after the label before. It is written smaller only where print to the
    right leaves less room. `clear` is asked as each label comes up, so it can take those that were written into account.
    """
    for row in label_rows([g.box for g in groups]):
        taken = 0
        for g in map(groups.__getitem__, row):
            x0, y0, x1, y1 = g.box
            left, margin = max(x0, taken), max(2, int(0.2 * (y1 - y0)))
            advance = extent(g.label, g.em)[0]
            stop = clear((y0, y1), max(left, min(width, x1 + margin)), int(left + advance + 8), g.colour)
            room = max(LEAST_ROOM, stop - left - 2)
            size = g.em if advance <= room else size_within(g.label, room, g.em, extent)
            advance, ink = extent(g.label, size)
            on_line = y1 - y0 <= ONE_LINE * g.tall
            yield Place(g.label, left + 1, y1 - max(1, int(0.18 * g.tall)) if on_line else _top(g.box, ink), size, on_line, g.colour)
            taken = int(left + advance + max(6, g.em // 3))


def name_places(named: list[tuple[Box, str]], extent: Extent, colour: tuple) -> Iterator[Place]:
    """Names in the middle of their boxes, as large as fits a quarter of the height and the width less a margin."""
    for box, name in named:
        wide, high = box[2] - box[0], box[3] - box[1]
        size = size_within(name, max(1, wide - 4), max(SMALLEST, high // 4), extent)
        ink = extent(name, size)[1]
        yield Place(name, box[0] + max(0, (wide - (ink[2] - ink[0])) // 2), _top(box, ink), size, False, colour)
