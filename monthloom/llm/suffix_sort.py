"""Sorting and sampling of byte suffixes with numpy: what one task does on its own rows."""

from __future__ import annotations

import numpy as np

SPAN = 50                   # length of the strings that are compared
GRAM = 16                   # leading bytes by which suffixes are chosen and dealt
WINDOW = SPAN - GRAM + 1    # grams in a string
WIDEST = 88                 # bytes around a chosen suffix: at most SPAN + WINDOW - 1, in whole words
_BLOCK = 1 << 19            # strings looked at together
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rows_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each place; the data must reach that far."""
    view = np.lib.stride_tricks.as_strided(data, shape=(len(data) - width + 1, width), strides=(1, 1))
    return view[at]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def chosen_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes of which every string of SPAN bytes holds one, the same one wherever the string occurs.

    ``data`` holds texts at [start, end) and at least WIDEST bytes more.  In
    each string the gram with the least hash is chosen.  Neighbouring strings
    mostly share it, so a result stands for a run of strings: place of the
    first and the last one, place and hash of the chosen gram.
    """
    stops = ends - SPAN + 1  # strings start before
    long = np.flatnonzero(stops > starts)
    begin, stop = starts[long], stops[long]
    found = []
    # blocks of whole texts, and pieces of texts longer than a block
    counts = -(-(stop - begin) // _BLOCK)
    first = np.repeat(begin, counts) + _BLOCK * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    last = np.minimum(first + _BLOCK, np.repeat(stop, counts))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + 2 * _BLOCK, side="right")))
        found.append(_runs(data, first[at:to], last[at:to]))
        at = to
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    base, top = int(first[0]), int(last[-1])
    words = _eights(data[base:top + SPAN + 8])
    hashes = mixed(words[:-8] * _A + words[8:] * _B)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & ~np.uint64(0xFF)) | (place & np.uint64(0xFF))
    reach = 1
    while 2 * reach <= WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < WINDOW:
        least = np.minimum(least[:reach - WINDOW], least[WINDOW - reach:])
    sizes = last - first
    strings = np.repeat(first - base - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    gram = strings + ((least[strings] - strings.astype(np.uint64)) & np.uint64(0xFF)).astype(np.int64)
    new = np.ones(len(strings), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (strings[1:] != strings[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(strings)) - 1
    return strings[heads] + base, strings[tails] + base, gram[heads] + base, hashes[gram[heads]]


def contexts(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of all strings from ``low`` to ``high``, a row each, zero behind them."""
    rows = rows_at(data, low, WIDEST).copy()
    rows[np.arange(WIDEST) >= (high - low + SPAN)[:, None]] = 0
    return rows


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big-endian eight-byte characters."""
    pad = -rows.shape[1] % 8
    if pad:
        rows = np.concatenate([rows, np.zeros((len(rows), pad), dtype=np.uint8)], axis=1)
    return list(np.ascontiguousarray(rows).view(">u8").astype(np.uint64).T)


def multikey_sort(characters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows, and the first character in which each row differs from the one before.

    As in multikey quicksort, rows are parted by one character, and only those
    that are still equal to a neighbour go on to the next.  A row equal to the
    one before differs in character ``len(characters)``.
    """
    n, equal = len(characters[0]), len(characters)
    order, differs = np.arange(n), np.full(n, equal)
    if n:
        differs[0] = -1
    for depth, character in enumerate(characters):
        cut = differs < depth
        alone = cut & np.append(cut[1:], True)
        rest = np.flatnonzero(~alone)
        if not len(rest):
            break
        run = np.cumsum(cut)[rest]
        order[rest] = order[rest][np.lexsort((character[order[rest]], run))]
        values = character[order[rest]]
        changed = (values[1:] != values[:-1]) & (run[1:] == run[:-1])
        differs[rest[1:][changed]] = depth
    return order, differs


def starts_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where runs begin, and the run of each row."""
    return np.flatnonzero(flags), np.cumsum(flags) - 1


def covered(gram: np.ndarray, strings: np.ndarray, rows: np.ndarray, owner: np.ndarray,
            at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first string, strings) that occur in a row of a smaller owner.

    Row i holds ``strings[i]`` strings with the chosen gram at ``gram[i]``.
    Rows are sorted by their gram and then by all their bytes: equal rows are
    covered by the smallest owner among them, and rows that share just the gram
    compare their strings one by one.
    """
    n = len(gram)
    if not n:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    view = np.ascontiguousarray(rows)
    lead = as_words(np.take_along_axis(view, gram[:, None] + np.arange(GRAM), axis=1))
    order, differs = multikey_sort([*lead, (gram * 64 + strings).astype(np.uint64), *as_words(view)])
    group_heads, group = starts_of(differs < len(lead))
    class_heads, kind = starts_of(differs < len(lead) + 1 + WIDEST // 8)
    smallest = np.minimum.reduceat(owner[order], class_heads)
    behind = owner[order] > smallest[kind]
    out = [(order[behind], np.zeros(int(behind.sum()), dtype=np.int64), strings[order[behind]])]
    # groups of several classes, some of them at a time
    class_group = group[class_heads]
    classes = np.flatnonzero(np.bincount(class_group, minlength=len(group_heads))[class_group] > 1)
    sample = order[class_heads[classes]]
    ends = np.cumsum(strings[sample])
    new_group = np.ones(len(classes), dtype=bool)
    new_group[1:] = class_group[classes][1:] != class_group[classes][:-1]
    heads = np.append(np.flatnonzero(new_group), len(classes))
    at = 0
    while at < len(heads) - 1:
        begin = heads[at]
        limit = (ends[begin - 1] if begin else 0) + at_once
        to = max(at + 1, int(np.searchsorted(ends[heads[1:] - 1], limit, side="right")))
        some = np.arange(begin, heads[to])
        out.append(_strings_covered(some, classes, sample, order, class_heads, kind, smallest, owner, strings, view))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out))


def _strings_covered(some, classes, sample, order, class_heads, kind, smallest, owner, strings, rows):
    """Single strings of the chosen classes that a smaller owner has as well."""
    sizes = strings[sample[some]]
    which = np.repeat(some, sizes)
    shift = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    texts = np.take_along_axis(rows[sample[which]], shift[:, None] + np.arange(SPAN), axis=1)
    by, differs = multikey_sort(as_words(texts))
    heads, run = starts_of(differs < -(-SPAN // 8))
    own = smallest[classes[which[by]]]
    hit = own > np.minimum.reduceat(own, heads)[run]
    hit_class, hit_shift = classes[which[by][hit]], shift[by][hit]
    # all rows of a class with its smallest owner; the others are covered whole already
    ends = np.append(class_heads[1:], len(order))
    counts = ends[hit_class] - class_heads[hit_class]
    member = np.repeat(class_heads[hit_class] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    target, moved = order[member], np.repeat(hit_shift, counts)
    keep = owner[target] == np.repeat(smallest[hit_class], counts)
    return target[keep], moved[keep], np.ones(int(keep.sum()), dtype=np.int64)
