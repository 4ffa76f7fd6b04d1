"""Series as sequences of codes from a codebook of motifs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tempora.kernels.subsequence import Alignment


def cover(values: Sequence[float], codebook: Sequence[Sequence[float]], compression: float = 0.5, expansion: float = 2.0, max_range_factor: float | None = None, knee_alpha: float | None = None, max_overlap: float | None = None) -> np.ndarray:
    """A code for each point: the motif whose match covers it; len(codebook) where none does.

    Matches are taken by decreasing score exp(-value / largest value) * length. Each paints
    the points still free, and takes out all others that it overlaps by more than the limit.
    """
    limit = max(compression, 1 / expansion) if max_overlap is None else max_overlap
    found = []
    for code, motif in enumerate(codebook):
        least, most = int(np.floor(len(motif) * compression)), int(np.ceil(len(motif) * expansion))
        for m in Alignment(motif, values).matches(k=None, min_length=max(2, least), max_length=most, max_range_factor=max_range_factor, knee_alpha=knee_alpha):
            found.append((code, m.begin, m.end + 1, m.value))
    out = np.full(len(values), len(codebook), np.int64)
    if not found:
        return out
    code, begin, end, value = (np.array(x) for x in zip(*found, strict=True))
    length = end - begin
    score = np.exp(-value / max(value.max(), 1e-300)) * length
    while (score > 0).any():
        best = int(score.argmax())
        part = out[begin[best] : end[best]]
        part[part == len(codebook)] = code[best]
        shared = np.minimum(end, end[best]) - np.maximum(begin, begin[best])
        score[shared / length > limit] = 0
        score[best] = 0
    return out


def pointwise(values: Sequence[float], codebook: Sequence[Sequence[float]], penalty: float = 0.1) -> np.ndarray:
    """codes x points: for each point the least value of a best match of the code that covers it."""
    out = np.full((len(codebook), len(values)), np.inf)
    for code, motif in enumerate(codebook):
        aligned = Alignment(motif, values, penalty)
        for idx in np.argsort(aligned.matching, kind="stable"):
            path = aligned.path_to(int(idx))
            if len(path):
                part = out[code, path[0, 1] : path[-1, 1] + 1]
                np.minimum(part, aligned.matching[idx], out=part)
    return out


def by_least(table: np.ndarray) -> np.ndarray:
    return table.argmin(0)


def by_vote(table: np.ndarray, window: int) -> np.ndarray:
    """Values become likelihoods of the codes, and each point takes the code most likely over the window from it on."""
    finite = np.where(np.isfinite(table), table, table[np.isfinite(table)].max(initial=1.0))
    similar = np.exp(-finite / max(finite.max(), 1e-300))
    weight = np.exp(similar - similar.max(0))
    log = np.log(weight / weight.sum(0))
    sums = np.concatenate([np.zeros((len(table), 1)), np.cumsum(log, 1)], 1)
    ends = np.minimum(np.arange(table.shape[1]) + window, table.shape[1])
    return (sums[:, ends] - sums[:, :-1]).argmax(0)


def hangover(codes: Sequence[int], threshold: int = 4) -> list[tuple[int, int, int]]:
    """(code + 1, begin, end) of runs that repeat their code more than `threshold` times, if the code differs
    from the one kept before. A run that is still open at the end isn't kept."""
    out: list[tuple[int, int, int]] = []
    begin = 0
    for k in range(1, len(codes)):
        if codes[k] != codes[k - 1]:
            if k - 1 - begin > threshold and (not out or out[-1][0] != codes[begin] + 1):
                out.append((int(codes[begin]) + 1, begin, k))
            begin = k
    return out
