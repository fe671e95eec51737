"""A gated recurrent language model in numpy, with a class-factored softmax.

Words are numbered by frequency; word w belongs to class w // size.  The model
gives the probability of the next word's class and of the word within its class,
so a step needs two short softmaxes instead of one over all words.

Texts run through parallel lanes, several one after another in a lane.  A lane is
worked on in windows: gradients stop at the window's start, the state goes on to
the next window, and is cleared where a text begins.  So every text is scored from
its first to its last word, whatever its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

STATE = 16
CLASS_SIZE = 64
LANES = 256
WINDOW = 16
RATE = 0.1
_START = 1e-2
# Logits are cut here, so that sums of their exponentials stay finite.
_MOST = np.float32(80)


class Lanes:
    """Texts side by side: words by place and lane, the longest lanes first."""

    def __init__(self, texts: list[np.ndarray], lanes: int = LANES):
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        heap = [(0, lane) for lane in range(min(lanes, len(texts)))]
        held: list[list[int]] = [[] for _ in heap]
        for k in order.tolist():
            load, lane = heapq.heappop(heap)
            held[lane].append(k)
            heapq.heappush(heap, (load + int(lengths[k]), lane))
        loads = [sum(int(lengths[k]) for k in own) for own in held]
        turn = sorted(range(len(held)), key=lambda lane: -loads[lane])
        self.loads = np.array([loads[lane] for lane in turn], dtype=np.int64)
        steps = int(self.loads.max(initial=0))
        self.words = np.zeros((steps, len(turn)), dtype=np.int32)
        self.first = np.zeros((steps, len(turn)), dtype=bool)
        # Where every text lies: lane, start, end.
        self.place = np.zeros((len(texts), 3), dtype=np.int64)
        for new, lane in enumerate(turn):
            at = 0
            for k in held[lane]:
                self.words[at : at + lengths[k], new] = texts[k]
                self.first[at : at + 1, new] = True
                self.place[k] = new, at, at + lengths[k]
                at += int(lengths[k])

    def windows(self, size: int, last: int) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
        """Places, number of lanes, words before and words of each window; ``last`` stands before a text."""
        before = np.vstack([np.full((1, self.words.shape[1]), last, np.int32), self.words[:-1]]) if len(self.words) else self.words
        before = np.where(self.first, last, before)
        for start in range(0, len(self.words), size):
            n = int((self.loads > start).sum())
            some = slice(start, min(start + size, len(self.words)))
            yield some, n, before[some, :n], self.words[some, :n]


class GatedModel:
    """The parameters; ``weights`` is all of them as one vector of floats."""

    def __init__(self, words: int, counts: np.ndarray | None = None, last: int = 0, state: int = STATE):
        self.words, self.state, self.last = words, state, last
        classes = -(-words // CLASS_SIZE)
        self.shapes = {
            "gates": (classes * CLASS_SIZE, 3 * state),
            "turn": (state, 3 * state),
            "to_class": (state, classes),
            "class_bias": (classes,),
            "to_word": (classes, state, CLASS_SIZE),
            "word_bias": (classes, CLASS_SIZE),
        }
        sizes = [int(np.prod(s)) for s in self.shapes.values()]
        self.ends = np.cumsum(sizes)
        rng = np.random.default_rng(11)
        self.weights = (rng.standard_normal(self.ends[-1]) * 0.1).astype(np.float32)
        self._name()
        if counts is not None:
            share = np.full(classes * CLASS_SIZE, 1e-6)
            share[:words] = np.maximum(counts, 1e-6)
            share = share.reshape(classes, CLASS_SIZE)
            # Before it has learned, the model knows how often words occur.
            self.to_class *= 0.1
            self.to_word *= 0.1
            self.class_bias[:] = np.log(share.sum(1) / share.sum())
            self.word_bias[:] = np.log(share / share.sum(1, keepdims=True))

    def _name(self) -> None:
        for (name, shape), part in zip(self.shapes.items(), np.split(self.weights, self.ends[:-1])):
            setattr(self, name, part.reshape(shape))

    def with_weights(self, weights: np.ndarray) -> GatedModel:
        other = GatedModel.__new__(GatedModel)
        other.__dict__.update({k: self.__dict__[k] for k in ("words", "state", "last", "shapes", "ends")})
        other.weights = np.array(weights, dtype=np.float32)
        other._name()
        return other

    # -- one window -------------------------------------------------------------------

    def _states(self, before: np.ndarray, first: np.ndarray, h: np.ndarray):
        """States after every step, and what the way back needs."""
        steps, n = before.shape
        s = self.state
        x = self.gates[before]
        keep = (~first).astype(np.float32)[:, :, None]
        held = np.empty((steps + 1, n, s), np.float32)
        begun = np.empty((steps, n, s), np.float32)
        gates = np.empty((steps, n, 2 * s), np.float32)
        news = np.empty((steps, n, s), np.float32)
        turned = np.empty((steps, n, s), np.float32)
        held[0] = h
        for t in range(steps):
            # Cleared where a text begins; the state before is still what the last word was guessed from.
            own = begun[t]
            np.multiply(held[t], keep[t], out=own)
            a = own @ self.turn
            g = gates[t]
            np.add(a[:, : 2 * s], x[t, :, : 2 * s], out=g)
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            turned[t] = a[:, 2 * s :]
            new = news[t]
            np.multiply(g[:, s:], turned[t], out=new)
            new += x[t, :, 2 * s :]
            np.tanh(new, out=new)
            # z h + (1 - z) new
            np.subtract(own, new, out=held[t + 1])
            held[t + 1] *= g[:, :s]
            held[t + 1] += new
        return held, begun, gates, news, turned, keep

    def _runs(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the words by class, and class, start and end of every run in it."""
        classes = (words // CLASS_SIZE).astype(np.min_scalar_type(len(self.to_word)))
        ends = np.cumsum(np.bincount(classes, minlength=len(self.to_word))).tolist()
        runs = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        return np.argsort(classes, kind="stable"), runs

    def _within(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the words of each state's class; states lie in runs of one class."""
        out = np.empty((len(h), CLASS_SIZE), np.float32)
        for c, a, b in runs:
            np.matmul(h[a:b], self.to_word[c], out=out[a:b])
            out[a:b] += self.word_bias[c]
        return out

    def log_probabilities(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithms for states and the words that follow them."""
        out = np.empty(len(words), np.float32)
        for start in range(0, len(words), LANES * WINDOW):
            own, target = h[start : start + LANES * WINDOW], words[start : start + LANES * WINDOW]
            counting = np.arange(len(target))
            logits = own @ self.to_class + self.class_bias
            found = np.minimum(logits[counting, target // CLASS_SIZE], _MOST)
            found -= _log_sum(logits)
            order, runs = self._runs(target)
            logits = self._within(own[order], runs)
            within = np.minimum(logits[counting, target[order] % CLASS_SIZE], _MOST)
            found[order] += within - _log_sum(logits)
            out[start : start + LANES * WINDOW] = found
        return out

    # -- whole texts ------------------------------------------------------------------

    def score(self, texts: list[np.ndarray], lanes: int = LANES, window: int = 4 * WINDOW) -> np.ndarray:
        """The natural log probability of every text, given as word numbers."""
        side = Lanes(texts, lanes)
        sums = np.zeros((len(side.words) + 1, side.words.shape[1]))
        h = np.zeros((side.words.shape[1], self.state), np.float32)
        for some, n, before, words in side.windows(window, self.last):
            held = self._states(before, side.first[some, :n], h[:n])[0]
            h[:n] = held[-1]
            found = self.log_probabilities(held[1:].reshape(-1, self.state), words.ravel())
            sums[some.start + 1 : some.stop + 1, :n] = found.reshape(words.shape)
        np.cumsum(sums, axis=0, out=sums)
        lane, start, end = side.place.T
        return sums[end, lane] - sums[start, lane]

    def train(self, texts: list[np.ndarray], squares: np.ndarray, rate: float = RATE, lanes: int = LANES) -> int:
        """One pass of truncated backpropagation over the texts; returns the number of words.

        ``squares`` holds the sums of squared gradients (Adagrad) and goes on.
        """
        side = Lanes(texts, lanes)
        seen = 0
        h = np.zeros((side.words.shape[1], self.state), np.float32)
        sums = {name: part.reshape(s) for (name, s), part in zip(self.shapes.items(), np.split(squares, self.ends[:-1]))}
        for some, n, before, words in side.windows(WINDOW, self.last):
            counted = np.arange(some.start, some.stop)[:, None] < side.loads[None, :n]
            h[:n] = self._step(before, words, side.first[some, :n], counted, h[:n], sums, rate)
            seen += int(counted.sum())
        return seen

    def _step(self, before, words, first, counted, h, sums, rate) -> np.ndarray:
        s = self.state
        held, begun, gates, news, turned, keep = self._states(before, first, h)
        steps, n = before.shape
        flat, target = held[1:].reshape(-1, s), words.ravel()
        # Few lanes make small steps, so that the longest texts do not have the last word.
        weight = (counted.ravel() / (LANES * WINDOW)).astype(np.float32)
        up: dict[str, np.ndarray] = {}
        # Classes.
        counting = np.arange(len(target))
        p = _softmax(flat @ self.to_class + self.class_bias, weight)
        p[counting, target // CLASS_SIZE] -= weight
        up["to_class"], up["class_bias"] = flat.T @ p, p.sum(0)
        dh = p @ self.to_class.T
        # Words within their classes, which lie side by side here.
        order, runs = self._runs(target)
        mine, places, shares = flat[order], target[order] % CLASS_SIZE, weight[order]
        p = _softmax(self._within(mine, runs), shares)
        p[counting, places] -= shares
        within, ones = np.empty_like(mine), np.ones(len(mine), np.float32)
        # Classes without words get no gradient and stay as they are.
        up["to_word"], up["word_bias"] = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        for c, a, b in runs:
            np.matmul(p[a:b], self.to_word[c].T, out=within[a:b])
            np.matmul(mine[a:b].T, p[a:b], out=up["to_word"][c])
            np.matmul(ones[a:b], p[a:b], out=up["word_bias"][c])
        dh[order] += within
        # Back through the window.
        dh = dh.reshape(steps, n, s)
        da = np.empty((steps, n, 3 * s), np.float32)
        back = np.zeros((n, s), np.float32)
        turned_back = np.ascontiguousarray(self.turn.T)
        tail = np.empty((steps, n, s), np.float32)
        z, r = gates[:, :, :s], gates[:, :, s:]
        by_news = (1 - z) * (1 - news**2)
        by_z = (begun - news) * z * (1 - z)
        by_r = turned * r * (1 - r)
        for t in range(steps - 1, -1, -1):
            back += dh[t]
            new = np.multiply(back, by_news[t], out=tail[t])
            np.multiply(back, by_z[t], out=da[t, :, :s])
            np.multiply(new, by_r[t], out=da[t, :, s : 2 * s])
            np.multiply(new, r[t], out=da[t, :, 2 * s :])
            back *= z[t]
            back += da[t] @ turned_back
            back *= keep[t]
        up["turn"] = begun.reshape(-1, s).T @ da.reshape(-1, 3 * s)
        da[:, :, 2 * s :] = tail
        # Gradients of the words before, added up per word.
        rows, at = np.unique(before.ravel(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(rows)))
        by_row = np.add.reduceat(da.reshape(-1, 3 * s)[order], starts, axis=0)
        own = sums["gates"][rows] + by_row**2
        sums["gates"][rows] = own
        self.gates[rows] -= rate * by_row / np.sqrt(own)
        for name, gradient in up.items():
            _adagrad(getattr(self, name), gradient, sums[name], rate)
        return held[-1]

    def squares(self) -> np.ndarray:
        """Sums of squared gradients to begin with."""
        return np.full(len(self.weights), _START**2, np.float32)


def _adagrad(weights: np.ndarray, gradient: np.ndarray, squares: np.ndarray, rate: float) -> None:
    squares += gradient * gradient
    gradient *= rate
    gradient /= np.sqrt(squares)
    weights -= gradient


def _softmax(logits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probabilities times the weight of each row."""
    np.minimum(logits, _MOST, out=logits)
    np.exp(logits, out=logits)
    logits *= (weight / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    return logits


def _log_sum(logits: np.ndarray) -> np.ndarray:
    np.minimum(logits, _MOST, out=logits)
    np.exp(logits, out=logits)
    return np.log(logits @ np.ones(logits.shape[1], np.float32))
