"""Anchors of texts: positions chosen by content, so that equal strings have anchors at equal places."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import _BYTES, _powers, mix

_PLACE_BITS = 25


@dataclass
class Anchors:
    """For each anchor: number of its text, position, hash of its gram and hash of its context."""

    text: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def find(data: list[bytes], window: int, gram: int, part: int = 1 << 18) -> Anchors:
    """The anchors of every text of at least `window` bytes.

    In each string of `window` bytes the gram of `gram` bytes with the least hash (the first of equal ones) is an anchor.
    So two equal strings have an anchor with equal grams at the same place. An anchor's context is what strings of
    `window` bytes that hold its gram can reach: window - gram bytes to each side, or up to the end of the text.
    """
    found: list[Anchors] = []
    at = 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < part):
            size += len(data[end])
            end += 1
        own = [i for i in range(at, end) if len(data[i]) >= window]
        for k in own if size > part else [None]:  # a text beyond the part goes alone, in overlapping stretches
            if k is None:
                found.append(_find([data[i] for i in own], np.array(own), window, gram))
            else:
                step = part - window
                for first in range(0, max(1, len(data[k]) - window + 1), step):
                    found.append(_find([data[k]], np.array([k]), window, gram, first, first + step))
        at = end
    out = Anchors(*(np.concatenate([getattr(f, c) for f in found]) if found else np.zeros(0, np.uint64) for c in ("text", "at", "gram", "context")))
    if len(out.at):  # stretches of one text may share an anchor
        keep = np.r_[True, (out.at[1:] != out.at[:-1]) | (out.text[1:] != out.text[:-1])]
        out = Anchors(out.text[keep], out.at[keep], out.gram[keep], out.context[keep])
    return out


def _find(data: list[bytes], names: np.ndarray, window: int, gram: int, first: int = 0, stop: int | None = None) -> Anchors:
    """Anchors of the strings that start in [first, stop) of each text."""
    margin = window - gram
    lo = max(0, first - margin)
    cut = [d[lo : None if stop is None else stop + 2 * window] for d in data]
    lengths = np.array([len(d) for d in cut], np.int64)
    empty = Anchors(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)))
    if not len(cut) or lengths.sum() < window:
        return empty
    buf = np.frombuffer(b"".join(cut), np.uint8)
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    power, inverse = _powers(len(buf) + 1)
    prefix = np.r_[np.uint64(0), np.cumsum(_BYTES[buf] * power[: len(buf)])]
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(buf) - gram + 1])
    keys = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = margin + 1  # grams in a window
    padded = np.full(-(-len(keys) // width) * width + width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n_windows = len(buf) - window + 1
    least = np.minimum(back[:n_windows], ahead[width - 1 : width - 1 + n_windows])
    valid = np.zeros(n_windows + 1, np.int64)
    for b, n in zip(begins.tolist(), lengths.tolist()):
        s = b + (first - lo)
        e = b + n - window + 1
        if stop is not None:
            e = min(e, b + stop - lo)
        if e > s:
            valid[s] += 1
            valid[e] -= 1
    places = (least[np.cumsum(valid[:-1]) > 0] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    if not len(places):
        return empty
    places = places[np.r_[True, places[1:] != places[:-1]]]
    owner = np.searchsorted(begins, places, "right") - 1
    left = np.maximum(places - margin, begins[owner])
    right = np.minimum(places + window, begins[owner] + lengths[owner])
    context = mix((prefix[right] - prefix[left]) * inverse[left] + (places - left).astype(np.uint64) * np.uint64(1_000_003) + (right - places).astype(np.uint64))
    return Anchors(names[owner], places - begins[owner] + lo, grams[places], context)
