"""Words of a text, and the exact test whether one text contains a run of another with few changes."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

# A word is a run of Latin letters or digits, or one Chinese character; all else is spacing, punctuation or markup. Single
# digits with blanks between them are one number, as in a text with a blank after each character.
_WORD = re.compile(r"[^\W_㐀-鿿豈-﫿぀-ヿ]+|[㐀-鿿豈-﫿぀-ヿ]")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_SPACED = re.compile(r"(?<!\w)\d(?:\s+\d(?!\w))+")
_SKIP = re.compile("[​-‏⁠﻿­̀-ͯ]")


def words(text: str | None) -> list[str]:
    """Words without letter case, width, spacing, line breaks, punctuation and markup."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _SKIP.sub("", unicodedata.normalize("NFKC", text)).lower()
    return _WORD.findall(_SPACED.sub(lambda m: "".join(m[0].split()), text))


def longest_run(errors: np.ndarray, rate: float) -> int:
    """Length of the longest stretch of ``errors`` (0 or 1 per word) with at most ``rate`` errors per word.

    A stretch begins and ends with a word that is right, so that an overlap isn't lengthened by what lies beside it.
    """
    right = errors == 0
    if not right.any():
        return 0
    s = np.concatenate([[0.0], np.cumsum(errors - rate)])
    # for each end the first start with s[start] >= s[end]: starts are where s reaches a new maximum
    top = np.maximum.accumulate(np.where(right, s[:-1], -np.inf))
    ends = np.nonzero(right)[0] + 1
    first = np.searchsorted(top, s[ends] - 1e-9, side="left")
    return int(np.max(np.where(first < ends, ends - first, 0)))


def aligned_errors(item: np.ndarray, window: np.ndarray, band: int) -> np.ndarray:
    """Error per item word in the cheapest alignment of the item with a window of a text.

    The window begins ``band`` words before the place where the item's first word is expected. Words added in the text
    count as an error of the item word before them. Banded, with free ends in the window.
    """
    n, m, width = len(item), len(window), 2 * band + 1
    far = 1 << 20
    cost = np.full((n + 1, width), far, np.int32)
    back = np.zeros((n + 1, width), np.int8)  # 0 pair, 1 item word missing in the text, 2 word added in the text
    cost[0] = 0
    off = np.arange(width)
    for i in range(1, n + 1):
        j = i - 1 + off  # index in the window of the word paired with item word i
        inside = (j >= 0) & (j < m)
        same = np.zeros(width, bool)
        same[inside] = window[j[inside]] == item[i - 1]
        pair = np.where(inside, cost[i - 1] + ~same, far)
        gone = np.full(width, far, np.int32)
        gone[:-1] = cost[i - 1][1:] + 1
        best = np.minimum(pair, gone)
        back[i] = np.where(pair <= gone, 0, 1)
        # words added: run along the row
        ext = np.minimum.accumulate(best - off) + off
        back[i][ext < best] = 2
        cost[i] = ext
    k = int(np.argmin(cost[n]))
    errors, i = np.zeros(n, np.int64), n
    while i > 0:
        b = back[i][k]
        if b == 2:
            errors[i - 1] += 1
            k -= 1
        elif b == 1:
            errors[i - 1] += 1
            i, k = i - 1, k + 1
        else:
            j = i - 1 + k
            errors[i - 1] += not (0 <= j < m and window[j] == item[i - 1])
            i -= 1
    return errors


def drift_of(n: int, rate: float) -> int:
    """Words by which the place of a run of an item of n words can shift within it: one for each change."""
    return int(np.floor(n * rate + 1e-9)) + 1


def contains(item: np.ndarray, doc: np.ndarray, item_sh: np.ndarray, doc_sh: np.ndarray, diagonals: list[int], share: float, rate: float, least: int) -> bool:
    """Whether the text holds at least ``share`` of the item's words in one run, at most ``rate`` of them changed.

    ``diagonals`` are places (text position less item position) where they share words. A place is looked at only if the
    window around it shares ``least`` shingles with the item, which any such run does. Replaced words are tried first;
    where they don't suffice, words may also be missing or added, as many as the item may have changed.
    """
    n = len(item)
    drift = drift_of(n, rate)
    band = 2 * drift  # from the middle of a group of places, which lies at most a drift from any of them
    need = int(np.ceil(share * n - 1e-9))
    groups: list[list[int]] = []
    for d in sorted(diagonals):
        if groups and d - groups[-1][0] <= drift:
            groups[-1].append(d)
        else:
            groups.append([d])
    for g in groups:
        lo, hi = max(0, g[0] - band), max(0, g[-1] + n + band)
        if np.isin(item_sh, doc_sh[lo:hi]).sum() < least:
            continue
        for d in g:
            a, b = max(0, -d), min(n, len(doc) - d)
            errors = np.ones(n, np.int64)
            errors[a:b] = item[a:b] != doc[a + d : b + d]
            if longest_run(errors, rate) >= need:
                return True
        start = g[len(g) // 2] - band
        window = doc[max(0, start) : max(0, g[-1] + n + band)]
        if start < 0:
            window = np.concatenate([np.zeros(-start, doc.dtype), window])
        if longest_run(aligned_errors(item, window, band), rate) >= need:
            return True
    return False
