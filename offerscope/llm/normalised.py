"""Documents with single separators: the kept words of a word table, joined by one space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from offerscope.llm.words import Words


@dataclass
class Joined:
    """The texts' bytes one after another; `offsets` cuts documents, `begin` and `end` are the kept words' places."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def joined(w: Words, keep: np.ndarray | None = None) -> Joined:
    """Kept words of each document (all where `keep` is none) with one space between two of them."""
    start, end, doc = (w.start, w.end, w.doc) if keep is None else (w.start[keep], w.end[keep], w.doc[keep])
    length = end - start
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = length + ~last
    stop = np.cumsum(size)
    begin = stop - size
    total = int(stop[-1]) if len(stop) else 0
    data = w.data[np.minimum(np.arange(total) + np.repeat(start - begin, size), max(len(w.data) - 1, 0))]
    data[stop[~last] - 1] = 0x20
    offsets = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(w.hi - w.lo + 1))]
    return Joined(data, offsets, begin, begin + length, doc)
