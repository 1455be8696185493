"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Words are numbered by falling count; the first ``WORDS - 1`` and the end mark
(number ``WORDS - 1``) are predicted one by one, all others share the number
``WORDS`` and one class. Classes are runs of ``CLASS`` neighbouring numbers, so
``P(word) = P(class | state) * P(word | class, state)``; biases start at the counted frequencies.
"""

from __future__ import annotations

import heapq

import numpy as np

WORDS, CLASS, HIDDEN = 1024, 32, 16
CLASSES = WORDS // CLASS + 1  # the last one holds all other words
END, OTHER = WORDS - 1, WORDS
WINDOW, LANES, SCORE_LANES = 32, 64, 256
SHAPES = {"embed": (WORDS + 1, HIDDEN), "w": (HIDDEN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
          "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (WORDS, HIDDEN), "word_b": (WORDS,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def started(counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights before training; ``counts`` of the numbers ``0 .. WORDS`` set the biases."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    counts = counts.astype(float) + 0.1
    mass = np.append(counts[:WORDS].reshape(-1, CLASS).sum(1), counts[WORDS])
    p["b"][:] = 0
    p["class_b"] = np.log(mass / mass.sum()).astype(np.float32)
    p["word_b"] = np.log(counts[:WORDS] / np.repeat(mass[:-1], CLASS)).astype(np.float32)
    p["word_w"] *= 0.1
    p["class_w"] *= 0.1
    return p


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    return views(flat.astype(np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = x * x.dtype.type(0.5)  # by the hyperbolic tangent, which doesn't overflow
    np.tanh(y, out=y)
    y *= 0.5
    y += 0.5
    return y


def lanes(documents: list[np.ndarray], count: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; longest lane first."""
    heap = [(0, i, []) for i in range(max(1, min(count, len(documents))))]
    for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
        n, i, held = heapq.heappop(heap)
        held.append(d)
        heapq.heappush(heap, (n + len(documents[d]), i, held))
    return [held for _, _, held in sorted(heap, key=lambda x: -x[0])]


class Stream:
    """Lanes of documents behind each other, cut into windows; held in arrays of the tokens' size, whatever the longest lane."""

    def __init__(self, documents: list[np.ndarray], dealt: list[list[int]]):
        self.sizes = [len(documents[d]) for held in dealt for d in held]
        self.lengths = np.array([sum(len(documents[d]) for d in held) for held in dealt])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.targets = np.concatenate([documents[d] for held in dealt for d in held] + [np.zeros(0, np.int32)])
        self.reset = np.zeros(len(self.targets), bool)
        firsts = np.cumsum([0, *self.sizes])[:-1]
        self.reset[firsts[firsts < len(self.targets)]] = True
        self.inputs = np.roll(self.targets, 1)
        self.inputs[self.reset] = END

    def window(self, t0: int, t1: int):
        """(inputs, targets, reset, valid) of the lanes that go on, longest first; (lanes, time)."""
        n = int(np.searchsorted(-self.lengths, -t0, "left"))
        at = np.arange(t0, t1)
        valid = at[None] < self.lengths[:n, None]
        at = np.where(valid, self.starts[:n, None] + at[None], 0)
        return np.where(valid, self.inputs[at], END), np.where(valid, self.targets[at], END), valid & self.reset[at], valid


def streams(documents: list[np.ndarray], dealt: list[list[int]]):
    """(inputs, targets, reset, lengths): lanes of documents behind each other; a document begins from the end mark and a zero state."""
    stream = Stream(documents, dealt)
    return *stream.window(0, int(stream.lengths.max(initial=0)))[:3], stream.lengths


class Space:
    """Arrays that are used again from window to window: fresh ones cost more than what is computed in them."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, kind, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if (name, kind) not in self.held or len(self.held[name, kind]) < n:
            self.held[name, kind] = np.empty(n, kind)
        return self.held[name, kind][:n].reshape(shape)

    def rows(self, name: str, x: np.ndarray) -> np.ndarray:
        """(time, features, lanes) as a row for each token, in the order of (time, lanes)."""
        out = self(name, x.dtype, x.shape[0], x.shape[2], x.shape[1])
        out[...] = x.transpose(0, 2, 1)
        return out.reshape(-1, x.shape[1])

    def take(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(x, at, axis=0, out=self(name, x.dtype, len(at), x.shape[1]), mode="clip")


def exps(x: np.ndarray, places, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities at ``places``, sums) of logits, which become their exponentials; ``small`` ones can't overflow."""
    if not small:
        x -= x.max(1, keepdims=True)
    picked = x[places]
    np.exp(x, out=x)
    sums = x.sum(1)
    return picked - np.log(sums), sums


def bounded(w: np.ndarray, b: np.ndarray, axis: int) -> bool:
    """Whether no state (of values up to 1) has a logit beyond the range of exponentials."""
    return float((np.abs(w).sum(axis) + np.abs(b)).max()) < 60


class Sorted:
    """States sorted by target, so that the words of a class are neighbours; the last ones have no word of their own."""

    def __init__(self, targets: np.ndarray):
        self.order = np.argsort(targets.astype(np.int16), kind="stable")  # a radix sort
        self.targets = targets[self.order]
        cuts = np.searchsorted(self.targets, np.arange(0, WORDS + 1, CLASS)).tolist()
        self.classes = [(c * CLASS, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        self.known = cuts[-1]
        rows = np.arange(len(targets))
        self.at, self.word_at = (rows, self.targets // CLASS), (rows[:self.known], self.targets[:self.known] % CLASS)

    def softmax(self, p, h: np.ndarray, space: Space):
        """Log probabilities of sorted states; exponentials and sums of the classes, and of the words in their class."""
        logits = np.matmul(h, p["class_w"], out=space("logits", h.dtype, len(h), CLASSES))
        logits += p["class_b"]
        words = space("words", h.dtype, self.known, CLASS)
        for w, a, b in self.classes:
            np.matmul(h[a:b], p["word_w"][w:w + CLASS].T, out=words[a:b])
            words[a:b] += p["word_b"][w:w + CLASS]
        found, sums = exps(logits, self.at, bounded(p["class_w"], p["class_b"], 0))
        within, word_sums = exps(words, self.word_at, bounded(p["word_w"], p["word_b"], 1))
        found[:self.known] += within
        return found, (logits, sums), (words, word_sums)


def log_probabilities(p, h: np.ndarray, targets: np.ndarray, space: Space | None = None) -> np.ndarray:
    """Natural log of P(target | state), a row for each."""
    space, by = space or Space(), Sorted(targets)
    found = by.softmax(p, space.take("top", h, by.order), space)[0]
    out = np.empty_like(found)
    out[by.order] = found
    return out


def gates(table, u, h, inputs, reset, space: Space):
    """States of a window and what its gradient needs: (time, features, lanes) arrays, so that gates are whole blocks."""
    steps, n = inputs.shape
    kind = table.dtype
    across = space("across", kind, 3 * HIDDEN, len(table))
    across[...] = table.T
    x = np.take(across, inputs, axis=1, out=space("x", kind, 3 * HIDDEN, steps, n), mode="clip")
    zr = space("zr", kind, steps, 2 * HIDDEN, n)
    own, new, before, states = (space(k, kind, steps, HIDDEN, n) for k in ("own", "new", "before", "states"))
    g, half, ut = space("g", kind, 3 * HIDDEN, n), kind.type(0.5), np.ascontiguousarray(u.T)
    for t in range(steps):
        before[t] = h
        if reset[t].any():
            before[t][:, reset[t]] = 0
        np.matmul(ut, before[t], out=g)
        a = zr[t]
        np.add(x[:2 * HIDDEN, t], g[:2 * HIDDEN], out=a)  # sigmoid by the hyperbolic tangent, which doesn't overflow
        a *= half
        np.tanh(a, out=a)
        a *= half
        a += half
        own[t] = g[2 * HIDDEN:]
        b = new[t]
        np.multiply(a[HIDDEN:], own[t], out=b)
        b += x[2 * HIDDEN:, t]
        np.tanh(b, out=b)
        h = states[t]
        np.subtract(before[t], b, out=h)
        h *= a[:HIDDEN]
        h += b
    return states, before, zr, own, new


def score(p, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document; the state is carried from window to window."""
    if not documents:
        return np.zeros(0)
    dealt = lanes(documents, SCORE_LANES)
    stream = Stream(documents, dealt)
    table = p["embed"] @ p["w"] + p["b"]
    out = np.zeros(len(stream.targets), np.float32)
    h, space = np.zeros((HIDDEN, len(dealt)), np.float32), Space()
    longest = int(stream.lengths.max())
    for t0 in range(0, longest, WINDOW):
        t1 = min(t0 + WINDOW, longest)
        inputs, targets, reset, valid = (x.T for x in stream.window(t0, t1))
        n = inputs.shape[1]
        states = gates(table, p["u"], h[:, :n], inputs, reset, space)[0]
        h = states[-1].copy()
        logs = log_probabilities(p, space.rows("rows", states), targets.ravel(), space).reshape(t1 - t0, n)
        out[(stream.starts[None, :n] + np.arange(t0, t1)[:, None])[valid]] = logs[valid]
    total = np.zeros(len(documents))
    for d, at, size in zip((d for held in dealt for d in held), np.cumsum([0, *stream.sizes]), stream.sizes):
        total[d] = out[at:at + size].sum(dtype=float)
    return total


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Weights as parts of one vector."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s)
        at += n
    return out


def gradients(p, inputs, targets, reset, weight, h, g=None, space: Space | None = None):
    """Gradients of a window (time, lanes) by backpropagation through it alone; the state (features, lanes) it ends in; the loss."""
    steps, n = inputs.shape
    kind = p["u"].dtype
    g, space = g or {k: np.empty(s, kind) for k, s in SHAPES.items()}, space or Space()
    block = lambda name, k=1: space(name, kind, steps, k * HIDDEN, n)
    table = np.matmul(p["embed"], p["w"], out=space("table", kind, WORDS + 1, 3 * HIDDEN))
    table += p["b"]
    states, before, zr, own, new = gates(table, p["u"], h, inputs, reset, space)
    by = Sorted(targets.ravel())
    top = space.take("top", space.rows("rows", states), by.order)
    w = None if weight.all() else weight.ravel()[by.order].astype(kind)
    found, (logs, sums), (words, word_sums) = by.softmax(p, top, space)
    loss = -float((found if w is None else found * w).sum())
    for x, s, places in ((logs, sums, by.at), (words, word_sums, by.word_at)):
        x *= (1 / s)[:, None]
        x[places] -= 1
        if w is not None:
            x *= w[:len(x), None]
    np.matmul(top.T, logs, out=g["class_w"])
    logs.sum(0, out=g["class_b"])
    down = np.matmul(logs, p["class_w"].T, out=space("down", kind, len(top), HIDDEN))
    g["word_w"][:], g["word_b"][:] = 0, 0
    for c, a, b in by.classes:
        np.matmul(words[a:b].T, top[a:b], out=g["word_w"][c:c + CLASS])
        words[a:b].sum(0, out=g["word_b"][c:c + CLASS])
        down[a:b] += np.matmul(words[a:b], p["word_w"][c:c + CLASS], out=space("part", kind, b - a, HIDDEN))
    flat = space("rows", kind, len(top), HIDDEN)
    flat[by.order] = down
    back = block("back")
    back[...] = flat.reshape(steps, n, HIDDEN).transpose(0, 2, 1)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    to_z, to_n, to_r, rest = (block(k) for k in ("to_z", "to_n", "to_r", "rest"))
    np.subtract(1, z, out=rest)
    np.subtract(before, new, out=to_z)
    to_z *= z
    to_z *= rest
    np.multiply(new, new, out=to_n)
    np.subtract(1, to_n, out=to_n)
    to_n *= rest
    np.subtract(1, r, out=rest)
    np.multiply(own, r, out=to_r)
    to_r *= rest
    dx, du = block("dx", 3), block("du", 3)
    u, carry = np.ascontiguousarray(p["u"]), np.zeros((HIDDEN, n), kind)
    for t in range(steps - 1, -1, -1):
        dh = back[t]
        dh += carry
        a, b = dx[t], du[t]
        np.multiply(dh, to_z[t], out=a[:HIDDEN])
        np.multiply(dh, to_n[t], out=a[2 * HIDDEN:])
        np.multiply(a[2 * HIDDEN:], to_r[t], out=a[HIDDEN:2 * HIDDEN])
        b[:2 * HIDDEN] = a[:2 * HIDDEN]
        np.multiply(a[2 * HIDDEN:], r[t], out=b[2 * HIDDEN:])
        np.matmul(u, b, out=carry)
        dh *= z[t]
        carry += dh
        if reset[t].any():
            carry[:, reset[t]] = 0
    np.matmul(space.rows("rows", before).T, space.rows("rows3", du), out=g["u"])
    of = np.argsort(inputs.ravel().astype(np.int16), kind="stable")  # a radix sort
    used, first = np.unique(inputs.ravel()[of], return_index=True)
    by_word = space("by_word", kind, len(used), 3 * HIDDEN)  # gradient of the table's rows
    np.add.reduceat(space.take("sorted3", space.rows("rows3", dx), of), first, axis=0, out=by_word)
    np.matmul(p["embed"][used].T, by_word, out=g["w"])
    by_word.sum(0, out=g["b"])
    g["embed"][:] = 0
    g["embed"][used] = np.matmul(by_word, p["w"].T, out=space("part", kind, len(used), HIDDEN))
    return g, states[-1].copy(), loss


class Trainer:
    """Adam steps over windows of lanes; as a document ends in a lane the next one begins there, also across calls."""

    def __init__(self, p, rate: float, lanes: int = LANES):
        self.flat = packed(p)
        self.p = views(self.flat)
        self.rate, self.step, self.tokens, self.count = rate, 0, 0, lanes
        self.m, self.v, self.g = np.zeros_like(self.flat), np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # what is left of each lane: inputs and targets
        self.h, self.space = np.zeros((HIDDEN, 0), np.float32), Space()

    def learn(self, documents: list[np.ndarray]) -> float:
        """One pass to the end of all documents; mean loss of a token."""
        lost, tokens = self.feed(documents)
        more, rest = self.feed([], True)
        return (lost + more) / max(1, tokens + rest)

    def feed(self, documents: list[np.ndarray], end: bool = False) -> tuple[float, int]:
        """Add documents, longest first to the shortest lane, and learn while all lanes are full (or to the end): (loss, tokens)."""
        while len(self.held) < min(self.count, len(self.held) + len(documents)):
            self.held.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
        self.h = np.pad(self.h, ((0, 0), (0, len(self.held) - self.h.shape[1])))
        heap = [(len(x[1]), i) for i, x in enumerate(self.held)]
        heapq.heapify(heap)
        parts = [[x] for x in self.held]
        for d in sorted(documents, key=len, reverse=True):
            n, i = heapq.heappop(heap)
            before = np.empty_like(d)
            before[0], before[1:] = -1, d[:-1]  # -1: from a zero state, after the end mark
            parts[i].append((before, d))
            heapq.heappush(heap, (n + len(d), i))
        lengths = np.array([sum(len(y) for _, y in x) for x in parts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths, self.h = lengths[order], self.h[:, order]
        lane = [tuple(np.concatenate([y[k] for y in parts[i]]) for k in (0, 1)) for i in order]
        starts = np.cumsum(lengths) - lengths
        inputs, targets = (np.concatenate([x[k] for x in lane] + [np.zeros(0, np.int32)]) for k in (0, 1))
        stop = int(lengths.max(initial=0)) if end else int(lengths.min(initial=0)) // WINDOW * WINDOW
        lost, tokens = 0.0, 0
        for t in range(0, stop, WINDOW):
            n = int(np.searchsorted(-lengths, -t, "left"))
            at = np.arange(t, min(t + WINDOW, stop))[:, None]
            valid = at < lengths[None, :n]
            at = np.where(valid, starts[None, :n] + at, 0)
            x = np.where(valid, inputs[at], END)
            reset = x < 0
            x[reset] = END
            _, self.h, loss = gradients(self.p, x, np.where(valid, targets[at], END), reset, valid, self.h[:, :n], views(self.g), self.space)
            self.apply(len(lane) * WINDOW)  # a window with few lanes left takes a small step
            lost, tokens = lost + loss, tokens + int(valid.sum())
        self.tokens += tokens
        self.held = [] if end else [(x[stop:], y[stop:]) for x, y in lane]
        self.h = np.zeros((HIDDEN, 0), np.float32) if end else self.h
        return lost, tokens

    def apply(self, n: int) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        g = self.g
        norm = np.sqrt(float(g @ g)) / n
        g *= np.float32(min(1.0, 1.0 / (norm + 1e-9)) / n)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        g *= g
        self.v *= np.float32(0.999)
        self.v += np.float32(0.001) * g
        np.sqrt(self.v, out=g)
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= np.float32(rate)
        self.flat -= g
