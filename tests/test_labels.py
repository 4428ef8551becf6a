"""Where labels go, with print of a fixed width: no font and no Pillow."""

import numpy as np

from hushframe.functions import pixels as px
from hushframe.operators.labels import Group, label_places, name_places, size_within


def extent(text, size):
    """Every letter is half as wide as its size; ink from a quarter of the size down to all of it."""
    return len(text) * size / 2, (0, size // 4, len(text) * size / 2, size)


def wide_open(rows, left, right, colour):
    return right


def test_labels_follow_each_other():
    groups = [Group((300, 100, 360, 120), "Person_2", 20, 20), Group((10, 102, 60, 122), "Organisation_11", 20, 20), Group((10, 300, 200, 380), "City_1", 16, 20)]
    second, first, block = label_places(groups, 1000, extent, wide_open)
    assert (second.text, second.x, second.y, second.size, second.on_line) == ("Organisation_11", 11, 119, 20, True)
    # the label before ends at 160, well before 300
    assert (first.text, first.x, first.y) == ("Person_2", 301, 117)
    # four heights of print: in the middle, by the ink's 12 of 80 pixels
    assert (block.x, block.y, block.on_line) == (11, 300 - 4 + 34, False)
    near = [Group((10, 0, 20, 20), "abcdefgh", 20, 20), Group((40, 0, 60, 20), "ij", 20, 20)]
    assert [p.x for p in label_places(near, 1000, extent, wide_open)] == [11, 98 - 1]


def test_print_in_the_way():
    image = np.full((40, 300, 3), 255, np.uint8)
    image[10:30, 90:95] = 0
    clear = lambda rows, left, right, colour: px.content_limit(image, rows, left, right, colour)
    (p,) = label_places([Group((20, 10, 60, 30), "abcdefghij", 20, 20)], 300, extent, clear)
    assert p.size == 13 and extent(p.text, p.size)[0] <= 90 - 20 - 2 < extent(p.text, p.size + 1)[0]
    image[10:30, 64:] = 0
    (p,) = label_places([Group((20, 10, 60, 30), "abcdefghij", 20, 20)], 300, extent, clear)
    assert p.size == 8  # too small for any, and never less


def test_sizes_and_names():
    assert size_within("abcd", 20, 30, extent) == 10 and size_within("abcd", 1, 30, extent) == 8 and size_within("abcd", 1, 5, extent) == 5
    (p,) = name_places([((100, 100, 200, 180), "[LOGO]")], extent, (1, 2, 3))
    assert (p.size, p.x, p.y, p.colour) == (20, 100 + 20, 100 - 5 + 32, (1, 2, 3))


def test_strips_around_a_box():
    image = np.zeros((30, 40, 3), np.uint8)
    image[8:22, 8:32] = (10, 20, 30)
    image[10:20, 10:30] = (200, 200, 200)
    assert px.surrounding(image, (10, 10, 30, 20)) == (10, 20, 30)
    edge = np.full((6, 6, 3), 7, np.uint8)
    assert px.surrounding(edge, (0, 0, 6, 6)) == (7, 7, 7) and px.surrounding(edge, (9, 9, 12, 12)) == (255, 255, 255)
    assert px.content_limit(image, (0, 30), 35, 35, (0, 0, 0)) == 35 and px.content_limit(image, (5, 25), 2, 40, (0, 0, 0)) == 10  # 30 is near enough, 200 not


def test_lines_of_any_filter_and_broken_files():
    import struct
    import zlib

    import pytest

    draw = np.random.default_rng(3)
    image = draw.integers(0, 256, (10, 9, 3)).astype(int)
    lines = []
    for y in range(10):
        for_line = bytearray([y % 5])
        for x in range(9):
            for c in range(3):
                a = image[y, x - 1, c] if x else 0
                b = image[y - 1, x, c] if y else 0
                d = image[y - 1, x - 1, c] if x and y else 0
                paeth = min((a, b, d), key=lambda v: (abs(a + b - d - v), (a, b, d).index(v)))
                for_line.append((image[y, x, c] - (0, a, b, (a + b) // 2, paeth)[y % 5]) % 256)
        lines.append(bytes(for_line))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 9, 10, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (px.from_bytes(data) == image).all()
    with pytest.raises(ValueError, match="checksum"):
        px.from_bytes(data[:45] + bytes([data[45] ^ 1]) + data[46:])
