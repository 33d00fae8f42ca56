"""A hidden Markov model that labels lines as prose, list, table or junk.

Each label has a few states; a state emits the binned statistics of a line, each independently. Starts, transitions and
emissions are estimated by Baum and Welch's method from lines of judged documents, whose verdict limits the states; the
most likely states of a document come from Viterbi's algorithm. Both run over many documents at once, line by line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from clicklake.llm.lines import BINS

LABELS = ("prose", "list", "table", "junk")
EACH = 4
#: What a line costs, in logarithms, under a label against its document's verdict while the model is estimated.
COST = 6.0
#: The same for a list, table or junk label other than the one guessed: verdicts don't tell these three apart.
HINT = 4.0
#: The label of each state.
LABEL_OF = np.repeat(np.arange(len(LABELS)), EACH)
_K = len(LABEL_OF)
_SIZES = tuple(BINS.values())
_OFFSET = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
_AT = {name: i for i, name in enumerate(BINS)}


def guess(codes: np.ndarray) -> np.ndarray:
    """A first label of each line by plain rules, where estimation starts."""
    c = {name: codes[:, i] for name, i in _AT.items()}
    junk = (c["odd"] >= 3) | (c["tags"] >= 3) | (c["seen"] >= 4) | (c["longest"] >= 5) | (c["letters"] <= 1) & (c["digits"] == 0) | (c["mixed"] >= 3)
    table = (c["cells"] >= 2) | (c["digits"] >= 4)
    prose = (c["familiar"] >= 4) | (c["familiar"] >= 3) & (c["words"] >= 3)
    return np.select([junk, table, prose], [3, 2, 0], np.where((c["words"] >= 5) & (c["capitals"] <= 1), 3, 1))


@dataclass
class LineModel:
    """Logarithms of the starts, transitions (from, to) and emissions (bins of all statistics, states), and the least share of prose."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    least: float

    def likelihood(self, codes: np.ndarray) -> np.ndarray:
        """Log-likelihood of each line under each state."""
        out = np.zeros((len(codes), _K))
        for i, at in enumerate(_OFFSET):
            out += self.emit[at + codes[:, i].astype(np.int64)]
        return out

    def labels(self, doc: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The label of each line on its document's most likely path; lines of a document stand together."""
        states = np.zeros(len(codes), np.int64)
        e = self.likelihood(codes)
        for rows, live in _steps(doc):
            best, back = None, []
            for t, (at, m) in enumerate(zip(rows, live)):
                if best is None:
                    best = self.start + e[at]
                    score = best.copy()
                    continue
                come = best[:m, :, None] + self.move
                arg = come.argmax(axis=1)
                best = np.take_along_axis(come, arg[:, None, :], 1)[:, 0] + e[at]
                back.append(arg)
                score[:m] = best
            now = score.argmax(axis=1)
            # documents are sorted from the longest, so those alive at a step come first
            for t in range(len(rows) - 1, -1, -1):
                m = live[t]
                states[rows[t]] = now[:m]
                if t:
                    now[:m] = back[t - 1][np.arange(m), now[:m]]
        return LABEL_OF[states]

    def shares(self, n_docs: int, doc: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(documents, labels): the share of each label in a document's characters; 0 everywhere without a line."""
        label = self.labels(doc, codes)
        out = np.bincount(doc * len(LABELS) + label, weight, n_docs * len(LABELS)).reshape(n_docs, -1)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def _steps(doc: np.ndarray, block: int = 4096):
    """Blocks of documents as (rows of their t-th lines for each t, how many documents have one), longest first."""
    if not len(doc):
        return
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([firsts, [len(doc)]]))
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), block):
        own = order[i : i + block]
        at, n = firsts[own], sizes[own]
        live = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
        yield [at[:m] + t for t, m in enumerate(live)], live


def estimate(doc: np.ndarray, codes: np.ndarray, weight: np.ndarray, prose: np.ndarray, rounds: int = 12, sharpen: int = 60, seed: int = 1) -> LineModel:
    """The model of judged documents: `prose` is the verdict on each line's document (1, 0, or NaN where there is none).

    Baum and Welch's rounds start from the guesses; a label against the document's verdict has a cost, so prose may hold a
    short list. Emissions and transitions are then sharpened by the gradient of the verdicts' likelihood: that of a document's
    paths under its own verdict against that of the paths under the other (maximum mutual information). The least share of
    prose is the one that tells the judged documents apart best. Without verdicts the first rounds alone decide.
    """
    rng = np.random.default_rng(seed)
    judged = ~np.isnan(prose)
    against = [np.where((LABEL_OF == 0) == (v == 0), -COST, 0.0) for v in (0, 1)]  # what states cost under either verdict
    limit = np.zeros((len(codes), _K))
    g = guess(codes)
    for v in (0, 1):
        limit[prose == v] = against[v]
    limit -= HINT * ((g[:, None] > 0) & (LABEL_OF[None, :] > 0) & (LABEL_OF[None, :] != g[:, None]))
    g = np.where(prose == 1, 0, np.where((prose == 0) & (g == 0), 1, g))
    gamma = (LABEL_OF[None, :] == g[:, None]) * (0.5 + rng.random((len(codes), _K)))
    seen, known = codes[:, _AT["seen"]], codes[:, _AT["familiar"]]  # two states of junk start from repetition, of sentences and of names
    gamma[:, -EACH] += 20.0 * ((g == 3) & (seen >= 4) & (known >= 3))
    gamma[:, 1 - EACH] += 20.0 * ((g == 3) & (seen >= 4) & (known < 3))
    move = np.full((_K, _K), 0.02) + np.eye(_K) * 4 + (LABEL_OF[:, None] == LABEL_OF[None, :]) * 0.5
    model = _of(np.ones(_K), move, _counts(codes, gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)))
    blocks = list(_steps(doc))
    for _ in range(rounds):
        start, move, gamma, _ = _expect(model, blocks, model.likelihood(codes) + limit)
        model = _of(start + 0.5, move + 0.5, _counts(codes, gamma))
    if judged.any() and 0 < prose[judged].mean() < 1:
        _sharpen(model, doc[judged], codes[judged], prose[judged], against, sharpen)
        model.least = _threshold(model, doc[judged], codes[judged], weight[judged], prose[judged])
    return model


def _sharpen(model: LineModel, doc: np.ndarray, codes: np.ndarray, prose: np.ndarray, against: list[np.ndarray], rounds: int, rate: float = 0.3, hold: float = 0.01, look: int = 5) -> None:
    """Gradient steps, each number at its own pace, with a pull of `hold` towards where they began.

    Documents whose verdict is certain add nothing; every `look` rounds all are judged anew, the rounds between take the others.
    """
    first_emit, first_move = model.emit.copy(), model.move.copy()
    pace_emit, pace_move = np.ones_like(model.emit), np.ones_like(model.move)
    own, other = np.where(prose[:, None] == 1, against[1], against[0]), np.where(prose[:, None] == 1, against[0], against[1])
    every = np.arange(len(doc))
    for i in range(rounds):
        at = every if i % look == 0 else live
        blocks = list(_steps(doc[at]))
        e = model.likelihood(codes[at])
        logs = [_expect(model, blocks, e + x[at]) for x in (own, other)]
        wrong = 1 / (1 + np.exp(np.clip(logs[0][3] - logs[1][3], -500, 500)))  # by document, how much the other verdict weighs
        by_line = _by_line(blocks, wrong, len(at))
        if i % look == 0:
            live = every[by_line > 1e-4]
            if not len(live):
                return
            near = by_line > 1e-4
            blocks, e, at, by_line = list(_steps(doc[live])), e[near], live, by_line[near]
            wrong = np.concatenate([by_line[rows[0]] for rows, _ in blocks])
        each = [_expect(model, blocks, e + x[at], wrong) for x in (own, other)]
        step = _counts(codes[at], (each[0][2] - each[1][2]) * by_line[:, None]) - hold * (model.emit - first_emit)
        moves = each[0][1] - each[1][1] - hold * (model.move - first_move)
        pace_emit += step**2
        pace_move += moves**2
        model.emit += rate * step / np.sqrt(pace_emit)
        model.move += rate * moves / np.sqrt(pace_move)


def _by_line(blocks: list, of_doc: np.ndarray, n: int) -> np.ndarray:
    """What documents have, in the blocks' order, at each of their lines."""
    out, k = np.zeros(n), 0
    for rows, live in blocks:
        for r, m in zip(rows, live):
            out[r] = of_doc[k : k + m]
        k += live[0]
    return out


def _threshold(model, doc, codes, weight, prose) -> float:
    at = np.unique(doc, return_inverse=True)[1]
    n = at.max() + 1
    share = model.shares(n, at, codes, weight)[:, 0]
    y = np.zeros(n)
    y[at] = prose
    tries = np.linspace(0.05, 0.95, 91)
    wrong = np.array([((share >= t) != (y > 0.5)).sum() for t in tries])
    best = np.flatnonzero(wrong == wrong.min())
    return float(tries[best].mean())


def _counts(codes: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    out = np.empty((sum(_SIZES), _K))
    for i, (at, size) in enumerate(zip(_OFFSET, _SIZES)):
        for k in range(_K):
            out[at : at + size, k] = np.bincount(codes[:, i], gamma[:, k], size)
    return out


def _of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, ghost: float = 0.3) -> LineModel:
    emit = emit + ghost
    for at, size in zip(_OFFSET, _SIZES):
        emit[at : at + size] /= emit[at : at + size].sum(axis=0)
    return LineModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit), 0.5)


def _expect(model: LineModel, blocks: list, e: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions (of documents by their weights) and states of each line, and the log-likelihood of each
    document in the blocks' order, by scaled sums forward and backward."""
    start, move, gamma, logs = np.zeros(_K), np.zeros((_K, _K)), np.zeros_like(e), []
    top = e.max(axis=1, keepdims=True)
    x = np.exp(e - top)
    pi, go = np.exp(model.start), np.exp(model.move)
    k = 0
    for rows, live in blocks:
        n = live[0]
        w = np.ones(n) if weights is None else weights[k : k + n]
        k += n
        a, scale, log = [], [], np.zeros(n)
        for t, (r, m) in enumerate(zip(rows, live)):
            now = x[r] * (pi if t == 0 else a[-1][:m] @ go) + 1e-290
            c = now.sum(axis=1)
            log[:m] += np.log(c) + top[r, 0]
            a.append(now / c[:, None])
            scale.append(c)
        b = np.ones((live[-1], _K))
        for t in range(len(rows) - 1, -1, -1):
            m = live[t]
            gamma[rows[t]] = a[t] * b
            if t:
                ahead = x[rows[t]] * b / scale[t][:, None]
                move += go * ((a[t - 1][:m] * w[:m, None]).T @ ahead)
                b = np.ones((live[t - 1], _K))
                b[:m] = ahead @ go.T
            else:
                start += w @ (a[0] * b)
        logs.append(log)
    return start, move, gamma, np.concatenate(logs) if logs else np.zeros(0)
