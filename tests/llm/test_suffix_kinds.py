"""Equal rows of a part."""

import numpy as np

from monthloom.llm import suffix_dedup


def test_equal_hashes_of_other_bytes_are_other_kinds():
    rows = np.array([[1, 2], [1, 2], [1, 3], [1, 3], [1, 3], [1, 3]], dtype=np.uint8)
    s = {"mark": np.array([5, 5, 5, 5, 5, 6]), "gram": np.zeros(6, dtype=np.int64), "strings": np.array([1, 1, 1, 1, 2, 2])}
    new_mark, new_kind = suffix_dedup._kinds(s, rows, np.zeros(6, dtype=np.uint64))
    assert new_mark.tolist() == [True, False, False, False, False, True]
    assert new_kind.tolist() == [True, False, True, False, True, True]
