"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import math

HIDDEN, WINDOW, LANES = 24, 24, 512
#: Fewer lanes learn from few symbols, so that there are about as many updates.
UPDATES = 64
#: Positions of a window, over all lanes, and lanes while scoring.
SCORE_POSITIONS, SCORE_LANES = 12_288, 512
#: Rows of the softmax over classes at a time, whose exponentials stay in the processor's cache.
SOFTMAX_ROWS = 640


def word_classes(weights, count: int, most: int = 192):
    """Where classes of words begin: words in order of falling counts, cut at equal shares of
    the sums of square roots, no class of more than ``most`` words."""
    import numpy as np

    n = len(weights)
    if n == 0:
        return np.zeros(1, np.int64)
    share = np.cumsum(np.sqrt(np.asarray(weights, np.float64)))
    at = np.minimum((share / share[-1] * count).astype(np.int64), count - 1)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), n]
    bounds = [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        bounds += list(range(a + most, b, most)) + [b] if b - a > most else [b]
    return np.unique(np.array(bounds))


class GRU:
    """Symbols are 0 (begin and end of a text), 1..words (frequent words) and then tails, which
    are classes of the other words. Output classes are 0 alone, the word classes, the tails.

    The update of state h by symbol s is z, r = sigmoid(in[s] + h U), c = tanh(in[s] + r (h U)),
    h = (1 - z) c + z h; begin resets the state first."""

    def __init__(self, word_weights, tails: int, prior=None, classes: int = 24, hidden: int = HIDDEN, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.bounds = word_classes(word_weights, classes)
        self.words, self.tails, self.hidden = len(word_weights), tails, hidden
        self.n_word_classes = len(self.bounds) - 1
        self.n_classes = 1 + self.n_word_classes + tails
        self.rooms: dict = {}
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"in": f(1 + self.words + tails, 3 * hidden), "u": f(hidden, 3 * hidden) * 3, "c": f(hidden, self.n_classes), "cb": np.zeros(self.n_classes, np.float32), "o": f(self.words, hidden), "ob": np.zeros(self.words, np.float32)}
        self.p["in"][:, :hidden] += 0.5
        if prior is not None:  # log counts of end, words and tails: the unigram distribution to begin with
            prior = np.asarray(prior, np.float64)
            w = prior[1 : 1 + self.words]
            self.p["ob"] = w.astype(np.float32)
            of = [np.logaddexp.reduce(w[a:b]) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
            self.p["cb"] = np.concatenate(([prior[0]], of, prior[1 + self.words :])).astype(np.float32)
        self.class_of = np.concatenate(([0], np.repeat(np.arange(self.n_word_classes), np.diff(self.bounds)) + 1, np.arange(tails) + 1 + self.n_word_classes)).astype(np.int64)

    def room(self, name: str, *shape):
        """An array of undefined numbers that is the same memory in every window, as fresh memory costs
        more than most passes over it. It is good until the next call with this name."""
        import numpy as np

        n, kind = math.prod(shape), self.p["u"].dtype
        if name not in self.rooms or len(self.rooms[name]) < n or self.rooms[name].dtype != kind:
            self.rooms[name] = np.empty(n, kind)
        return self.rooms[name][:n].reshape(shape)

    def split_in(self):
        """The inputs' and states' weights of update, reset and candidate one after the other, as
        ``forward`` takes them: those of both gates halved, as sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        import numpy as np

        found = [np.ascontiguousarray(self.p[n].reshape(-1, 3, self.hidden).transpose(1, 0, 2)) for n in ("in", "u")]
        for w in found:
            w[:2] *= 0.5
        return found

    def forward(self, h, symbols, split):
        """States [time, lanes, hidden] before and after each of ``symbols`` [time, lanes]; gates and
        candidates [3, time, lanes, hidden], and what the reset gate multiplies. Each is contiguous:
        numpy takes several times as long over parts of rows."""
        import numpy as np

        (w, u), (steps, lanes), k = split, symbols.shape, self.hidden
        x = self.room("x", 3, steps, lanes, k)
        for g in range(3):
            np.take(w[g], symbols, axis=0, out=x[g], mode="clip")
        before, after, y = (self.room(name, steps, lanes, k) for name in ("before", "after", "y"))
        zr, ry = self.room("zr", 2, lanes, k), self.room("ry", lanes, k)
        at, lane = np.nonzero(symbols == 0)
        cut = np.searchsorted(at, np.arange(steps + 1))
        for t in range(steps):
            b = before[t]
            b[:] = h
            b[lane[cut[t] : cut[t + 1]]] = 0
            np.matmul(b, u[:2], out=zr)
            gate = x[:2, t]
            gate += zr
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            c = x[2, t]
            np.matmul(b, u[2], out=y[t])
            np.multiply(gate[1], y[t], out=ry)
            c += ry
            np.tanh(c, out=c)
            h = after[t]
            np.subtract(b, c, out=h)
            h *= gate[0]
            h += c
        return before, after, x, y

    @staticmethod
    def spread(h, w, bias, picked, gradient: bool):
        """Log-probabilities of the columns ``picked`` in the softmax of each row of ``h w + bias``, and
        the gradients of their sum, negated, by w, bias and h. Biases are factors and sums are divided
        by after the products, which spares passes over the exponentials."""
        import numpy as np

        e = h @ w
        at = np.arange(0, e.size, e.shape[1]) + picked
        flat = e.reshape(-1)
        out = flat[at]
        out += bias[picked]
        scale = np.exp(bias)
        np.exp(e, out=e)
        total = e @ scale
        log = np.log(total)
        if not (log.min() > -40 and log.max() < 40 and np.abs(bias).max() < 40):  # too large or too small for such products
            np.matmul(h, w, out=e)
            e += bias
            top = e.max(1)
            e -= top[:, None]
            np.exp(e, out=e)
            scale = np.ones_like(bias)
            total = e @ scale
            log = np.log(total) + top
        out -= log
        if not gradient:
            return out, None, None, None
        flat[at] -= total / scale[picked]
        inverse = 1 / total
        dh = e @ (w * scale).T
        dh *= inverse[:, None]
        return out, ((h * inverse[:, None]).T @ e) * scale, (inverse @ e) * scale, dh

    def log_probs(self, hs, targets, grads=None):
        """Natural log-probabilities of target symbols (a tail: of its class) after states; with
        ``grads`` to fill, their gradients by states too, in memory that the next call uses again."""
        import numpy as np

        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):  # spread sees to them
            return self._log_probs(hs, targets, grads)

    def _log_probs(self, hs, targets, grads):
        import numpy as np

        p, gradient = self.p, grads is not None
        order = np.argsort(targets, kind="stable")
        t, h = targets[order], np.take(hs, order, axis=0, out=self.room("h", *hs.shape), mode="clip")
        cls, log, dh = self.class_of[t], self.room("log", len(t)), self.room("dh", *hs.shape)
        if gradient:
            grads |= {name: np.zeros_like(p[name]) for name in ("c", "cb", "o", "ob")}
        for a in range(0, len(t), SOFTMAX_ROWS):
            s = slice(a, a + SOFTMAX_ROWS)
            log[s], dw, db, d = self.spread(h[s], p["c"], p["cb"], cls[s], gradient)
            if gradient:
                grads["c"] += dw
                grads["cb"] += db
                dh[s] = d
        cut = np.searchsorted(t, self.bounds + 1)
        for k in range(self.n_word_classes):
            a, b, s = self.bounds[k], self.bounds[k + 1], slice(cut[k], cut[k + 1])
            if cut[k] == cut[k + 1] or b - a == 1:
                continue
            inside, dw, db, d = self.spread(h[s], p["o"][a:b].T, p["ob"][a:b], t[s] - (1 + a), gradient)
            log[s] += inside
            if gradient:
                grads["o"][a:b], grads["ob"][a:b] = dw.T, db
                dh[s] += d
        out = np.empty_like(log)
        out[order] = log
        if not gradient:
            return out
        back = self.room("back", *dh.shape)
        back[order] = dh
        return out, back

    @staticmethod
    def sums(x, first):
        """Sums of the runs of rows that begin at ``first``; two numbers are added as one complex
        number where rows are even, which halves the time."""
        import numpy as np

        if x.shape[1] % 2 or x.dtype != np.float32:
            return np.add.reduceat(x, first, axis=0)
        return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)

    def window_gradient(self, h, symbols, targets, weights):
        """Log-probabilities, gradients and the last state of a window [lanes, time]: truncated
        backpropagation, the state before the window being a constant."""
        import numpy as np

        lp, g, (rows, dx), h = self.time_gradient(h, *(np.ascontiguousarray(x.T) for x in (symbols, targets)), weights.T > 0)
        return lp, g, (rows, dx.transpose(1, 0, 2).reshape(len(rows), -1)), h

    def time_gradient(self, h, symbols, targets, real):
        """``window_gradient`` for [time, lanes]; the gradients by inputs are [3, time * lanes, hidden]."""
        import numpy as np

        k, (steps, lanes) = self.hidden, symbols.shape
        before, after, x, y = self.forward(h, symbols, self.split_in())
        g: dict = {}
        if real.all():
            lp, dhs = self.log_probs(after.reshape(-1, k), targets.reshape(-1), g)
            dhs = dhs.reshape(steps, lanes, k)
        else:
            lp, dh_real = self.log_probs(after[real], targets[real], g)
            dhs = np.zeros(after.shape, after.dtype)
            dhs[real] = dh_real
        # Gradients take the places of what they are made from, a step at a time, while the cache holds them.
        u = np.ascontiguousarray(self.p["u"].reshape(k, 3, k).transpose(1, 2, 0))
        by_u = np.zeros_like(u)
        at, lane = np.nonzero(symbols == 0)
        cut = np.searchsorted(at, np.arange(steps + 1))
        carry, part = np.zeros((lanes, k), after.dtype), np.empty((lanes, k), after.dtype)
        for t in range(steps - 1, -1, -1):
            b, d, (z, r, c), dy = before[t], dhs[t], x[:, t], y[t]
            d += carry
            np.multiply(d, z, out=carry)
            d -= carry  # d (1 - z)
            np.subtract(b, c, out=part)
            part *= d
            z *= part
            c *= c
            np.subtract(1, c, out=c)
            c *= d
            np.subtract(1, r, out=part)
            part *= r
            part *= dy
            part *= c
            np.multiply(c, r, out=dy)
            r[:] = part
            for e, w, total in zip((z, r, dy), u, by_u, strict=True):
                carry += np.matmul(e, w, out=part)
                total += b.T @ e
            carry[lane[cut[t] : cut[t + 1]]] = 0
        g["u"] = np.concatenate(by_u, axis=1)
        return lp, g, (symbols.reshape(-1), x.reshape(3, -1, k)), after[-1].copy()

    def train(self, texts, rate: float = 0.08, lanes: int = LANES, window: int = WINDOW, squares=None):
        """One pass over symbol arrays (each a text, without begin and end), by Adagrad."""
        import numpy as np

        if squares is None:
            squares = {n: np.full_like(v, 1e-2) for n, v in self.p.items()}
        flat = np.zeros(1 + sum(len(x) + 1 for x in texts), np.int16)
        at = 1
        for x in texts:
            flat[at : at + len(x)] = x
            at += len(x) + 1
        n = len(flat) - 1
        if n < 1:
            return squares
        lanes = max(1, min(lanes, n // (window * UPDATES)))
        steps = -(-n // lanes)
        pad = np.zeros(lanes * steps - n, np.int16)
        inputs, targets = (np.ascontiguousarray(np.append(x, pad).reshape(lanes, steps).T) for x in (flat[:-1], flat[1:]))
        real = np.ascontiguousarray((np.arange(lanes * steps) < n).reshape(lanes, steps).T)
        h = np.zeros((lanes, self.hidden), np.float32)
        for at in range(0, steps, window):
            s = slice(at, at + window)
            if not real[s].any():
                break
            lp, g, (rows, dx), h = self.time_gradient(h, inputs[s], targets[s], real[s])
            scale = np.float32(1.0 / max(1, len(lp)) * lanes)
            for name, d in g.items():
                d *= scale
                np.clip(d, -5, 5, out=d)
                squares[name] += d * d
                d *= rate
                d /= np.sqrt(squares[name])
                self.p[name] -= d
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            u = rows[first]
            room = self.room("ordered", *dx.shape[1:])
            d = np.concatenate([self.sums(np.take(x, order, axis=0, out=room, mode="clip"), first) for x in dx], axis=1)
            d *= scale
            np.clip(d, -5, 5, out=d)
            squares["in"][u] += d * d
            d *= rate
            d /= np.sqrt(squares["in"][u])
            self.p["in"][u] -= d
        return squares

    def score(self, texts, lanes: int = SCORE_LANES, window: int | None = None):
        """Natural log-probability of each text's symbols and its end. Texts are laid end to end in
        lanes that run in step; the state is carried through every window of a text."""
        import heapq

        import numpy as np

        n = np.array([len(x) + 1 for x in texts], np.int64)
        if not len(n):
            return np.zeros(0)
        lanes = int(max(1, min(lanes, len(n), -(-int(n.sum()) // int(n.max())) + 1)))
        heap = [(0, k) for k in range(lanes)]
        at = np.empty((len(n), 2), np.int64)
        for i in np.argsort(-n, kind="stable"):
            used, k = heapq.heappop(heap)
            at[i] = k, used
            heapq.heappush(heap, (used + int(n[i]), k))
        steps = max(used for used, _ in heap)
        window = window or SCORE_POSITIONS // lanes
        inputs, targets, doc = np.zeros((steps, lanes), np.int16), np.zeros((steps, lanes), np.int16), np.full((steps, lanes), -1, np.int32)
        for i, x in enumerate(texts):
            k, a = at[i]
            inputs[a + 1 : a + n[i], k] = x
            targets[a : a + n[i] - 1, k] = x
            doc[a : a + n[i], k] = i
        total = np.zeros(len(n))
        h, split = np.zeros((lanes, self.hidden), np.float32), self.split_in()
        for a in range(0, steps, window):
            b = min(steps, a + window)
            hs = self.forward(h, inputs[a:b], split)[1]
            h = hs[-1].copy()
            d, flat, after = doc[a:b].reshape(-1), hs.reshape(-1, self.hidden), targets[a:b].reshape(-1)
            real = d >= 0
            if not real.all():
                d, flat, after = d[real], flat[real], after[real]
            if len(d):
                total += np.bincount(d, self.log_probs(flat, after), len(n))
        return total
