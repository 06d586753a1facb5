"""A two-label linear-chain conditional random field over the lines of documents.

Label 1 is content (good), label 0 boilerplate (bad). A line's score for label 1 is linear in its features (label 0
scores 0); a 2 x 2 table scores neighbouring labels. Sequences of a batch are worked on side by side, longest first,
so that every step is one array operation over the sequences that are still running.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .bytewords import U64, Runs, lines, words

#: Characters that mark junk in the quality rules.
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "symbols > 0.5 %", "symbols > 3 %", "upper case > 30 %", "upper case > 60 %", "exclamations > 2 %", "digits > 20 %",
    "word repeated at once > 10 %", "word repeated at once > 40 %", "equal to an earlier line", "fewer than 4 words", "no word",
    "ends a sentence", "words longer than 12", "log words",
)
_LUT = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "digit", "exclamation", "stop", "head")}
_LUT["symbol"][[ord(c) for c in SYMBOLS]] = True
_LUT["upper"][ord("A") : ord("Z") + 1] = True
_LUT["letter"][ord("A") : ord("Z") + 1] = True
_LUT["letter"][ord("a") : ord("z") + 1] = True
_LUT["digit"][ord("0") : ord("9") + 1] = True
_LUT["exclamation"][ord("!")] = True
_LUT["stop"][[ord(c) for c in ".!?"]] = True
_LUT["head"][:0x80] = True
_LUT["head"][0xC0:] = True  # the first byte of every code point


def count_between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def repeats_earlier(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each key occurred earlier in the same text."""
    order = np.lexsort((np.arange(len(keys)), keys, text))
    k, t = keys[order], text[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return out


@dataclass
class LineTable:
    """Lines of a batch of texts with their features; ``n_words``, ``n_chars`` (code points) and ``duplicate`` per line."""

    runs: Runs
    features: np.ndarray
    n_words: np.ndarray
    n_chars: np.ndarray
    duplicate: np.ndarray


def line_table(column: pa.Array) -> LineTable:
    runs, w = lines(column), words(column)
    data = runs.data
    share = lambda name, of: count_between(_LUT[name][data], runs.start, runs.end) / np.maximum(of, 1)
    n_chars = count_between(_LUT["head"][data], runs.start, runs.end)
    first, last = np.searchsorted(w.start, runs.start), np.searchsorted(w.start, runs.end)
    n_words = last - first
    h = w.hashes()
    line_of = np.repeat(np.arange(len(runs.start)), n_words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    immediate = np.bincount(line_of[same], minlength=len(runs.start)) / np.maximum(n_words, 1)
    duplicate = repeats_earlier(runs.hashes(), runs.text) & (n_words > 0)
    symbol = share("symbol", n_chars)
    upper = count_between(_LUT["upper"][data], runs.start, runs.end) / np.maximum(count_between(_LUT["letter"][data], runs.start, runs.end), 1)
    tail = np.zeros(len(runs.start), bool)
    filled = n_words > 0
    tail[filled] = _LUT["stop"][data[w.end[last[filled] - 1] - 1]]
    features = np.stack([
        np.ones(len(runs.start)), symbol > 0.005, symbol > 0.03, upper > 0.3, upper > 0.6, share("exclamation", n_chars) > 0.02,
        share("digit", n_chars) > 0.2, immediate > 0.1, immediate > 0.4, duplicate, n_words < 4, ~filled, tail,
        n_chars / np.maximum(n_words, 1) > 12, np.log1p(n_words) / 5,
    ], axis=1).astype(np.float32)
    return LineTable(runs, features, n_words, n_chars, duplicate)


def with_neighbours(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Features of the line before and after appended to each line's own; zeros at the ends of a text."""
    same = (text[1:] == text[:-1])[:, None]
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:] = features[:-1] * same
    after[:-1] = features[1:] * same
    return np.concatenate([features, before, after], axis=1)


class _Grid:
    """Sequences as columns sorted by length, longest first: step t touches the first ``alive[t]`` of them."""

    def __init__(self, text: np.ndarray):
        _, first, length = np.unique(text, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        steps = int(self.length[0]) if len(self.length) else 0
        self.alive = np.searchsorted(-self.length, -np.arange(steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.alive[t]] + t


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _messages(score: np.ndarray, jump: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Grid]:
    """Forward and backward log messages of every line, and log Z of every line's sequence."""
    grid = _Grid(text)
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    forward, backward, log_z = np.zeros_like(emit), np.zeros_like(emit), np.zeros(len(score))
    for t in range(len(grid.alive)):
        i = grid.at(t)
        forward[i] = emit[i] if not t else emit[i] + _log_sum(forward[i - 1][:, :1] + jump[0], forward[i - 1][:, 1:] + jump[1])
    for t in range(len(grid.alive) - 2, -1, -1):
        i = grid.first[: grid.alive[t + 1]] + t
        ahead = emit[i + 1] + backward[i + 1]
        backward[i] = _log_sum(ahead[:, :1] + jump[:, 0], ahead[:, 1:] + jump[:, 1])
    ends = grid.first + grid.length - 1
    log_z_of = _log_sum(forward[ends, 0], forward[ends, 1])
    log_z[np.repeat(grid.first, grid.length) + np.concatenate([np.arange(n) for n in grid.length] or [np.zeros(0, int)])] = np.repeat(log_z_of, grid.length)
    return forward, backward, log_z, grid


@dataclass
class Model:
    weights: np.ndarray
    jump: np.ndarray

    def marginals(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every line, by forward-backward."""
        if not len(features):
            return np.zeros(0)
        forward, backward, log_z, _ = _messages(features @ self.weights, self.jump, text)
        return np.exp(forward[:, 1] + backward[:, 1] - log_z)

    def viterbi(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Labels of the most probable sequence of every text; ties go to label 1."""
        if not len(features):
            return np.zeros(0, bool)
        score = features @ self.weights
        grid = _Grid(text)
        best, back = np.zeros((len(score), 2)), np.zeros((len(score), 2), bool)
        for t in range(len(grid.alive)):
            i = grid.at(t)
            best[i, 1] = score[i]
            if t:
                via = best[i - 1][:, :, None] + self.jump[None]  # from, to
                back[i] = via[:, 1] >= via[:, 0]
                best[i] += via.max(axis=1)
        label = np.zeros(len(score), bool)
        ends = grid.first + grid.length - 1
        label[ends] = best[ends, 1] >= best[ends, 0]
        for t in range(len(grid.alive) - 2, -1, -1):
            i = grid.first[: grid.alive[t + 1]] + t
            label[i] = back[i + 1, label[i + 1].astype(int)]
        return label


#: Scores used where no labelled rows of both kinds exist: symbols, capitals and repeated words speak against a line.
PRIOR = Model(np.array([2, -2, -3, -2, -2, -2, -1, -2, -3, -1, 0, 0, 0.5, 0, 0.5]), np.array([[0.5, 0.0], [0.0, 0.5]]))


def train(
    features: np.ndarray, text: np.ndarray, label: np.ndarray, penalty: float = 1.0, rounds: int = 100, held: np.ndarray | None = None
) -> Model:
    """Penalised maximum likelihood by Adam; deterministic. ``label`` is 0 or 1 per line. With ``held`` as the weights of
    the features, only the transitions are fitted."""
    n, k = features.shape
    x, y = features.astype(float), label.astype(int)
    params, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    if held is not None:
        params[:k] = held
    inner = text[1:] == text[:-1]
    pair = np.zeros((2, 2))
    np.add.at(pair, (y[:-1][inner], y[1:][inner]), 1)
    seen = x.T @ y
    follow = np.flatnonzero(inner)
    for step in range(1, rounds + 1):
        weights, jump = params[:k], params[k:].reshape(2, 2)
        score = x @ weights
        forward, backward, log_z, _ = _messages(score, jump, text)
        p1 = np.exp(forward[:, 1] + backward[:, 1] - log_z)
        emit = np.stack([np.zeros(n), score], axis=1)
        joint = forward[follow][:, :, None] + jump[None] + (emit + backward)[follow + 1][:, None, :] - log_z[follow][:, None, None]
        gradient = np.concatenate([seen - x.T @ p1, (pair - np.exp(joint).sum(axis=0)).ravel()]) - penalty * params
        gradient /= max(n, 1)
        if held is not None:
            gradient[:k] = 0
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(params[:k], params[k:].reshape(2, 2))


def train_by_line(features: np.ndarray, text: np.ndarray, label: np.ndarray) -> Model:
    """Fit where ``label`` is the text's and not the line's, for labels of single lines.

    Such labels never switch within a text, so transitions fitted on them forbid switches. Here the line scores are
    fitted first, every line on its own; the labels they give switch where lines differ, and the transitions are fitted
    to those with the scores held.
    """
    weights = train(features, np.arange(len(text)), label).weights
    return train(features, text, features @ weights >= 0, held=weights)


def repeated_window_words(w: Runs, size: int) -> np.ndarray:
    """Per text: words inside windows of ``size`` words that occur twice or more in it, the first occurrence included."""
    from .bytewords import covered, inside, window_hashes

    if not len(w.start):
        return np.zeros(w.n_texts, np.int64)
    keys, ok = window_hashes(w.hashes(), size), inside(w.text, size)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(w.n_texts, np.int64)
    order = np.lexsort((keys[at], w.text[at]))
    k, t = keys[at][order], w.text[at][order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.bincount(w.text, covered(at[order[twice]], size, len(w.start)), w.n_texts).astype(np.int64)


def code_points_in_words(w: Runs) -> np.ndarray:
    return w.per_text(count_between(_LUT["head"][w.data], w.start, w.end))


def symbols(w: Runs) -> np.ndarray:
    return count_between(_LUT["symbol"][w.data], w.offsets[:-1], w.offsets[1:])


__all__ = ["FEATURES", "PRIOR", "SYMBOLS", "LineTable", "Model", "U64", "code_points_in_words", "line_table", "repeated_window_words", "symbols", "train", "train_by_line", "with_neighbours"]
