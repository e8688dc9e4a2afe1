"""A gated recurrent unit with a class-factored softmax, in numpy.

Words 0..V-1 are ordered by class: class c holds words ``first[c]`` up to
``first[c + 1]``. P(word | history) = P(class | h) * P(word | class, h), so a step
needs one row of class scores and the words of one class. Parameters are one flat
float32 vector, which makes averaging models simple.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes of a model: words, classes (their first words and the end), width of the state."""

    first: np.ndarray
    width: int

    @property
    def words(self) -> int:
        return int(self.first[-1])

    @property
    def classes(self) -> int:
        return len(self.first) - 1

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes), np.diff(self.first))

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h = self.width
        return [
            ("embed", (self.words + 1, 3 * h)),  # input weights of each word; the last row starts a text
            ("recur", (h, 3 * h)),
            ("class_w", (h, self.classes)),
            ("class_b", (self.classes,)),
            ("word_w", (h, self.words)),
            ("word_b", (self.words,)),
        ]

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the parts of a flat vector."""
        views, at = {}, 0
        for name, shape in self.parts():
            size = int(np.prod(shape))
            views[name] = flat[at : at + size].reshape(shape)
            at += size
        return views

    def size(self) -> int:
        return sum(int(np.prod(shape)) for _, shape in self.parts())


def initial(shape: Shape, frequency: np.ndarray, seed: int = 1) -> np.ndarray:
    """Small random weights; the biases are log frequencies, so the untrained model is the unigram model."""
    flat = np.random.default_rng(seed).normal(0, 0.1, shape.size()).astype(np.float32)
    p = shape.split(flat)
    classes = np.add.reduceat(frequency.astype(np.float64), shape.first[:-1])
    p["class_w"] *= 0.1
    p["word_w"] *= 0.1
    p["class_b"][:] = np.log(classes)
    p["word_b"][:] = np.log(frequency / np.repeat(classes, np.diff(shape.first)))
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(p: dict[str, np.ndarray], words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what its gradient needs."""
    n = h.shape[1]
    x = p["embed"][words]
    inner = h @ p["recur"]
    gates = _sigmoid(x[:, : 2 * n] + inner[:, : 2 * n])
    update, reset = gates[:, :n], gates[:, n:]
    new = np.tanh(x[:, 2 * n :] + reset * inner[:, 2 * n :])
    return new + update * (h - new), update, reset, new, inner[:, 2 * n :]


def _advance(x: np.ndarray, before: np.ndarray, recur: np.ndarray, gates: np.ndarray, inner_new: np.ndarray, new: np.ndarray, state: np.ndarray) -> None:
    """``step`` for states in columns, into the given arrays: units lie behind each other, so that every part is contiguous."""
    n = len(before)
    inner = recur @ before
    np.add(x[: 2 * n], inner[: 2 * n], out=gates)
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    inner_new[:] = inner[2 * n :]
    np.multiply(gates[n:], inner_new, out=new)
    new += x[2 * n :]
    np.tanh(new, out=new)
    np.subtract(before, new, out=state)
    state *= gates[:n]
    state += new


#: Scores that can be nowhere beyond this are exponentiated as they are.
SAFE_SCORE = 60.0


def _normalized(scores: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(scores) by row up to a factor, in place, and the logarithm of its sum without that factor.

    ``scores`` are states @ weight + bias. No state is beyond 1, so the sizes of
    weights and biases bound them; only where they could be large is each row's
    maximum taken off.
    """
    top = 0.0
    if not float((np.abs(weight).sum(axis=0) + np.abs(bias)).max()) < SAFE_SCORE:
        top = scores.max(axis=1)
        scores -= top[:, None]
    total = np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype)
    return total, top + np.log(total)


def _by_class(shape: Shape, classes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, first word, end) of each class of several words that occurs."""
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    ends = np.searchsorted(classes[order], np.arange(shape.classes + 1))
    for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(shape.first) > 1)):
        yield order[ends[c] : ends[c + 1]], int(shape.first[c]), int(shape.first[c + 1])


def log_probability(shape: Shape, p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Natural log P(target | state) of many states; rows of a class are scored together."""
    classes = class_of[targets]
    scores = states @ p["class_w"]
    scores += p["class_b"]
    out = scores[np.arange(len(targets)), classes]
    out -= _normalized(scores, p["class_w"], p["class_b"])[1]
    for rows, a, b in _by_class(shape, classes):
        weight, bias = p["word_w"][:, a:b], p["word_b"][a:b]
        scores = states[rows] @ weight
        scores += bias
        chosen = scores[np.arange(len(rows)), targets[rows] - a]
        out[rows] += chosen - _normalized(scores, weight, bias)[1]
    return out


def _softmax_gradient(s: np.ndarray, place: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed negative log-likelihood of the places under softmax(s @ weight + bias), and its gradient by the scores."""
    scores = s @ weight
    scores += bias
    at = np.arange(len(place))
    chosen = scores[at, place]
    total, logs = _normalized(scores, weight, bias)
    scores /= total[:, None]
    scores[at, place] -= 1
    return float((logs - chosen).sum()), scores


def _columns(blocks: np.ndarray) -> np.ndarray:
    """Each block with rows and columns exchanged."""
    return np.ascontiguousarray(blocks.transpose(0, 2, 1))


def window_gradient(
    shape: Shape, p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, class_of: np.ndarray
) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient of the summed negative log-likelihood over a window, that sum, and the state after it.

    ``inputs`` and ``targets`` are (steps, rows); the state ``h`` comes from the
    window before and is a constant (truncated backpropagation). A start symbol
    clears the state when it is read and is no target.
    """
    steps, rows = inputs.shape
    n = shape.width
    flat = np.zeros(shape.size(), np.float32)
    g = shape.split(flat)
    before, states = np.empty((steps, n, rows), np.float32), np.empty((steps, n, rows), np.float32)
    gates, new, inner_new = np.empty((steps, 2 * n, rows), np.float32), np.empty((steps, n, rows), np.float32), np.empty((steps, n, rows), np.float32)
    going = (inputs != shape.words)[:, None].astype(np.float32)
    x = _columns(p["embed"][inputs])
    recur = np.ascontiguousarray(p["recur"].T)
    h = h.T
    for t in range(steps):
        np.multiply(h, going[t], out=before[t])
        h = states[t]
        _advance(x[t], before[t], recur, gates[t], inner_new[t], new[t], h)
    counted = np.flatnonzero(targets.ravel() != shape.words)
    # Targets of a class lie together, so that its rows are a slice.
    counted = counted[np.argsort(class_of[targets.ravel()[counted]].astype(np.uint16), kind="stable")]
    s, y = _columns(states).reshape(-1, n)[counted], targets.ravel()[counted]
    classes = class_of[y]
    loss, d = _softmax_gradient(s, classes, p["class_w"], p["class_b"])
    ones = np.ones(len(y), d.dtype)
    g["class_w"][:], g["class_b"][:] = s.T @ d, ones @ d
    ds = d @ p["class_w"].T
    ends = np.searchsorted(classes, np.arange(shape.classes + 1))
    for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(shape.first) > 1)):
        k, a, b = slice(ends[c], ends[c + 1]), shape.first[c], shape.first[c + 1]
        more, d = _softmax_gradient(s[k], y[k] - a, p["word_w"][:, a:b], p["word_b"][a:b])
        loss += more
        g["word_w"][:, a:b], g["word_b"][a:b] = s[k].T @ d, ones[k] @ d
        ds[k] += d @ p["word_w"][:, a:b].T
    spread = np.zeros((steps * rows, n), np.float32)
    spread[counted] = ds
    ds = _columns(spread.reshape(steps, rows, n))
    # What does not depend on the gradient of the next step, for all steps at once.
    update, reset = gates[:, :n], gates[:, n:]
    slope_new = (1 - update) * (1 - new * new)
    slope_update = (before - new) * update * (1 - update)
    slope_reset = inner_new * reset * (1 - reset)
    dh = np.zeros((n, rows), np.float32)
    dx, d_inner = np.empty((steps, 3 * n, rows), np.float32), np.empty((steps, 3 * n, rows), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        d_new = dx[t, 2 * n :]
        np.multiply(dh, slope_new[t], out=d_new)
        np.multiply(dh, slope_update[t], out=dx[t, :n])
        np.multiply(d_new, slope_reset[t], out=dx[t, n : 2 * n])
        d_inner[t, : 2 * n] = dx[t, : 2 * n]
        np.multiply(d_new, reset[t], out=d_inner[t, 2 * n :])
        dh *= update[t]
        dh += p["recur"] @ d_inner[t]
        dh *= going[t]
    g["recur"][:] = (before @ d_inner.transpose(0, 2, 1)).sum(axis=0)
    order = np.argsort(inputs.ravel().astype(np.uint16) if shape.words < 2**16 else inputs.ravel(), kind="stable")
    words = inputs.ravel()[order]
    cuts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    g["embed"][words[cuts]] = np.add.reduceat(_columns(dx).reshape(-1, 3 * n)[order], cuts, axis=0)
    return flat, loss, states[-1].T


def lanes_of(shape: Shape, texts: list[np.ndarray], lanes: int) -> np.ndarray:
    """The texts end to end, each behind a start symbol, in rows of equal length; (steps, lanes).

    A row that begins inside a text begins without its state. The last row is
    filled up with start symbols, which are no targets. Fewer lanes than asked for
    are used when rows would be shorter than two words.
    """
    if not texts:
        return np.zeros((0, 1), np.int32)
    stream = np.empty(sum(map(len, texts)) + len(texts) + 1, np.int32)
    at = 0
    for text in texts:
        stream[at], stream[at + 1 : at + 1 + len(text)] = shape.words, text
        at += len(text) + 1
    stream[at] = shape.words
    lanes = max(1, min(lanes, at // 2))
    length = -(-at // lanes)
    # Each row ends with the word that the next one begins with: it is its last target.
    filled = np.full(lanes * length + 1, shape.words, np.int32)
    filled[: at + 1] = stream
    places = np.arange(length + 1)[:, None] + np.arange(lanes) * length
    return filled[places]


def train(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], *, lanes: int = 256, steps: int = 24, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """The weights after one pass over all words of the texts, and the number of words seen.

    Windows of ``steps`` words follow each other in every lane with the state
    carried over, and a start symbol resets it at each text. Adam with the gradient
    of each window.
    """
    class_of = shape.class_of()
    flat = flat.copy()
    p = shape.split(flat)
    rows = lanes_of(shape, texts, lanes)
    first, second, moved = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    h = np.zeros((rows.shape[1], shape.width), np.float32)
    beta1, beta2 = 0.9, 0.99
    for number, at in enumerate(range(0, len(rows) - 1, steps), 1):
        targets = rows[at + 1 : at + steps + 1]
        gradient, _, h = window_gradient(shape, p, rows[at : at + len(targets)], targets, h, class_of)
        gradient /= targets.size
        norm = float(np.sqrt(gradient @ gradient))
        if norm > 1:
            gradient /= norm
        first *= beta1
        first += np.multiply(gradient, 1 - beta1, out=moved)
        second *= beta2
        gradient *= gradient
        second += np.multiply(gradient, 1 - beta2, out=moved)
        np.sqrt(second, out=moved)
        moved *= 1 / np.sqrt(1 - beta2**number)
        moved += 1e-8
        np.divide(first, moved, out=moved)
        moved *= rate / (1 - beta1**number)
        flat -= moved
    return flat, sum(map(len, texts))


#: States that are scored together.
SCORED_STATES = 16_384


def score_texts(shape: Shape, p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole text.

    All texts advance together, longest first, so those that still run are a prefix.
    States are scored some thousands at a time and the last ones go on, so memory
    follows the number of texts and not their lengths.
    """
    total = np.zeros(len(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    stream = np.concatenate([texts[k] for k in order]) if len(texts) else np.zeros(0, np.int64)
    start = np.cumsum(lengths) - lengths
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left").tolist()
    class_of = shape.class_of()
    width = shape.width
    recur = np.ascontiguousarray(p["recur"].T)
    h = np.zeros((width, len(texts)), np.float32)
    word = np.full(len(texts), shape.words)
    scores = np.zeros(len(texts))
    states, targets, rows, held = [], [], [], 0
    for t, n in enumerate(running):
        before = np.ascontiguousarray(h[:, :n])
        parts = np.empty((5 * width, n), np.float32)
        gates, inner_new, new, h = parts[: 2 * width], parts[2 * width : 3 * width], parts[3 * width : 4 * width], parts[4 * width :]
        _advance(np.ascontiguousarray(p["embed"][word[:n]].T), before, recur, gates, inner_new, new, h)
        word = stream[start[:n] + t]
        states.append(h.T)
        targets.append(word)
        rows.append(n)
        held += n
        if held >= SCORED_STATES or t + 1 == len(running):
            logs = log_probability(shape, p, np.concatenate(states), np.concatenate(targets), class_of)
            cut = 0
            for n in rows:
                scores[:n] += logs[cut : cut + n]
                cut += n
            states, targets, rows, held = [], [], [], 0
    total[order] = scores
    return total
