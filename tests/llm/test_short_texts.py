"""Slices with fewer words than a shingle."""

import numpy as np
import pytest

from hushframe.llm import textops


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_one_short_text(n):
    hashes = np.arange(1, n + 1, dtype=np.uint64)
    sets = textops.shingle_sets(hashes, np.array([0, n]), 5)
    assert len(sets[0]) == (max(1, n - 4) if n else 0)
    # as in a slice with other texts
    more = textops.shingle_sets(np.concatenate([hashes, np.arange(50, 60, dtype=np.uint64)]), np.array([0, n, n + 10]), 5)
    assert sets[0].tolist() == more[0].tolist()
