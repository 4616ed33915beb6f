"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy.

Characters are one-hot, so a table of gate inputs by character stands for the
input weights.  Training minimises the CRF's negative log likelihood with Adam;
gradients go through the chain by forward-backward sums in probability space
(rescaled at every step) and through time by hand-written back-propagation.
"""

from __future__ import annotations

import string

import numpy as np

#: Characters with an input of their own (fixed values); others fall in classes by kind.
OWN = string.ascii_letters + string.punctuation + " \n"
DIGIT, LETTER, SPACE, REST = range(len(OWN), len(OWN) + 4)
INPUTS = len(OWN) + 4
_ASCII = np.full(128, REST, np.int64)
for _i, _c in enumerate(OWN):
    _ASCII[ord(_c)] = _i
_ASCII[[ord(c) for c in string.digits]] = DIGIT
_ASCII[[ord(c) for c in "\t\r\x0b\x0c"]] = SPACE


def inputs(text: str) -> np.ndarray:
    """Input number of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _ASCII[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127):
        c = chr(points[i])
        out[i] = DIGIT if c.isdigit() else LETTER if c.isalpha() else SPACE if c.isspace() else REST
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Tags are 0 (outside) and, for each kind k, 1 + 2k (begin) and 2 + 2k (inside)."""

    def __init__(self, kinds: int, hidden: int = 20, seed: int = 5):
        self.tags, self.hidden = 1 + 2 * kinds, hidden
        rng = np.random.default_rng(seed)
        h, k = hidden, self.tags
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.w = {"out": draw(2 * h, k, s=(2 * h) ** -0.5), "bias": np.zeros(k, np.float32)}
        for d in "fb":
            gates = draw(INPUTS, 4 * h, s=0.3)
            gates[:, h : 2 * h] += 1.0  # forget gates start open
            self.w |= {f"in{d}": gates, f"re{d}": draw(h, 4 * h, s=h**-0.5)}
        self.w |= {"move": np.zeros((k, k), np.float32), "first": np.zeros(k, np.float32)}
        # an inside tag follows only a begin or inside tag of its kind
        self.allowed = np.ones((k, k), bool)
        for inside in range(2, k, 2):
            self.allowed[:, inside] = False
            self.allowed[[inside - 1, inside], inside] = True
        self.may_start = np.ones(k, bool)
        self.may_start[2::2] = False

    # LSTM

    def _run(self, x: np.ndarray, keep: bool):
        """Hidden states (T, 2, B, H) over inputs (T, B), both directions side by side; the second reads backwards."""
        h, (steps, batch) = self.hidden, x.shape
        recur = np.stack([self.w["ref"], self.w["reb"]])
        given = np.empty((steps, 2, batch, 4 * h), recur.dtype)
        given[:, 0], given[:, 1] = self.w["inf"][x], self.w["inb"][x[::-1]]
        state = np.zeros((2, batch, h), recur.dtype)
        cell = np.zeros_like(state)
        out = np.empty((steps, 2, batch, h), recur.dtype)
        saved = []
        for t in range(steps):
            z = given[t] + state @ recur
            gate = _sigmoid(z[..., : 3 * h])
            i, f, o = gate[..., :h], gate[..., h : 2 * h], gate[..., 2 * h :]
            g = np.tanh(z[..., 3 * h :])
            if keep:
                saved.append((i, f, o, g, cell, state))
            cell = f * cell + i * g
            state = o * np.tanh(cell)
            out[t] = state
        return out, (saved, cell)

    def _back(self, x: np.ndarray, grad: np.ndarray, kept, sums: dict) -> None:
        """Adds the gradients of the input and recurrent weights for gradients (T, 2, B, H) of the states."""
        h, (steps, batch), (saved, cell) = self.hidden, x.shape, kept
        back = np.stack([self.w["ref"].T, self.w["reb"].T])
        dz_all = np.empty((steps, 2, batch, 4 * h), back.dtype)
        dh, dc = np.zeros_like(cell), np.zeros_like(cell)
        d_recur = np.zeros((2, h, 4 * h), back.dtype)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, state = saved[t]
            dh = dh + grad[t]
            squashed = np.tanh(cell)
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = dz_all[t]
            dz[..., :h] = dc * g * i * (1 - i)
            dz[..., h : 2 * h] = dc * before * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * squashed * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - g * g)
            d_recur += state.transpose(0, 2, 1) @ dz
            dh, dc, cell = dz @ back, dc * f, before
        for d, inputs_, name in ((0, x, "f"), (1, x[::-1], "b")):
            hot = np.zeros((INPUTS, steps * batch), back.dtype)
            hot[inputs_.reshape(-1), np.arange(steps * batch)] = 1
            sums[f"in{name}"], sums[f"re{name}"] = hot @ dz_all[:, d].reshape(-1, 4 * h), d_recur[d]

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores (T, B, K) for inputs (T, B)."""
        states, kept = self._run(x, keep)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        return both @ self.w["out"] + self.w["bias"], (both, kept)

    # chain

    def _chain(self, scores: np.ndarray):
        """Scaled forward and backward sums, and the log partition of each sequence."""
        steps, batch, k = scores.shape
        move = np.where(self.allowed, np.exp(self.w["move"]), 0).astype(np.float64)
        first = np.where(self.may_start, np.exp(self.w["first"]), 0).astype(np.float64)
        top = scores.max(axis=2, keepdims=True)
        local = np.exp((scores - top).astype(np.float64))
        ahead, behind = np.empty((steps, batch, k)), np.empty((steps, batch, k))
        log_z = top.sum(axis=0)[:, 0].astype(np.float64)
        now = first * local[0]
        for t in range(steps):
            if t:
                now = (now @ move) * local[t]
            scale = now.sum(axis=1, keepdims=True)
            log_z += np.log(scale[:, 0])
            ahead[t] = now = now / scale
        now = np.ones((batch, k))
        for t in range(steps - 1, -1, -1):
            behind[t] = now
            now = (now * local[t]) @ move.T
            now /= now.sum(axis=1, keepdims=True)
        return ahead, behind, local, move, log_z

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of every tag at every place (T, B, K)."""
        ahead, behind, *_ = self._chain(scores)
        both = ahead * behind
        return both / both.sum(axis=2, keepdims=True)

    def loss(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of gold tags (T, B), and its gradients."""
        scores, (both, kept) = self.scores(x, keep=True)
        steps, batch, k = scores.shape
        ahead, behind, local, move, log_z = self._chain(scores)
        share = ahead * behind
        share /= share.sum(axis=2, keepdims=True)
        hot = np.eye(k)[gold]
        pair = ahead[:-1, :, :, None] * move * (local[1:] * behind[1:])[:, :, None, :]
        d_move = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
        np.add.at(d_move, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), -1)
        right = np.take_along_axis(scores, gold[:, :, None], 2)[:, :, 0].sum(axis=0)
        right = right + self.w["move"][gold[:-1], gold[1:]].sum(axis=0) + self.w["first"][gold[0]]
        d_scores = ((share - hot) / batch).astype(np.float32)
        sums = {
            "move": (d_move * self.allowed / batch).astype(np.float32),
            "first": ((share[0] - hot[0]).sum(axis=0) * self.may_start / batch).astype(np.float32),
            "out": both.reshape(-1, both.shape[2]).T @ d_scores.reshape(-1, k),
            "bias": d_scores.sum(axis=(0, 1)),
        }
        d_both = d_scores @ self.w["out"].T
        self._back(x, np.stack([d_both[:, :, : self.hidden], d_both[::-1, :, self.hidden :]], 1), kept, sums)
        return float((log_z - right).mean()), sums

    def fit(self, batches, rate: float = 0.02) -> list[float]:
        """Adam over (inputs, tags) batches; the rate falls to a tenth. Returns the losses."""
        batches = list(batches)
        one = {n: np.zeros_like(v) for n, v in self.w.items()}
        two = {n: np.zeros_like(v) for n, v in self.w.items()}
        losses = []
        for step, (x, gold) in enumerate(batches, 1):
            loss, sums = self.loss(x, gold)
            losses.append(loss)
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in sums.values())))
            clip = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * 0.1 ** (step / len(batches))
            for n, g in sums.items():
                g = g * np.float32(clip)
                one[n] = 0.9 * one[n] + 0.1 * g
                two[n] = 0.99 * two[n] + 0.01 * g * g
                self.w[n] -= (now * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tag paths (T, B)."""
        steps, batch, k = scores.shape
        move = np.where(self.allowed, self.w["move"], np.float32(-1e6))
        best = np.where(self.may_start, self.w["first"], np.float32(-1e6)) + scores[0]
        came = np.empty((steps, batch, k), np.int8)
        for t in range(1, steps):
            all_ = best[:, :, None] + move
            came[t] = all_.argmax(axis=1)
            best = all_.max(axis=1) + scores[t]
        path = np.empty((steps, batch), np.int64)
        path[-1] = best.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t][rows, path[t]]
        return path
