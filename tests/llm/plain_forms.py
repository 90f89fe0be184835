"""Plain forms shared by tests."""

import re
from collections import Counter

from test_packing import plain as plain_pack
from test_simhash import plain_components

__all__ = ["best_alignment", "plain_components", "plain_pack", "words_plainly"]


def words_plainly(text):
    words = [re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()]
    return [w for w in words if w]


def best_alignment(item, words):
    """The best local score (match 1, mismatch and gap -1), cell by cell.

    Where even all words in common could not reach half of the item, that bound itself.
    """
    most = sum((Counter(item) & Counter(words)).values())
    if most < min(len(item), max(6, len(item) / 2)):
        return most
    best, above = 0, [0] * (len(words) + 1)
    for a in item:
        row, left = [0], 0
        for j, b in enumerate(words):
            left = max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, left - 1)
            row.append(left)
        best, above = max(best, max(row)), row
    return best
