"""A small causal self-attention model in numpy: forward, backward, Adam.

One attention layer and one hidden layer over windows of subword ids, where the ids of a frequent word are one step. It
predicts the class of the next step, as a correction of how often classes follow the last one in the corpus; within a
class there are fixed shares. The most frequent steps are classes of their own; the others are grouped by the company
that they keep in texts, and by frequency.
"""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN, WINDOW, OVERLAP = 16, 32, 32, 6
OWN_CLASS, SLOTS = 64, 4096
#: Symbols without a class of their own: bins of word starts by kind and frequency, and bins of ids within words.
KINDS, START_BINS, INNER_BINS = 8, 5, 8
CLASSES = OWN_CLASS + KINDS * START_BINS + INNER_BINS
#: Symbols whose company decides what kinds there are; others go with those that begin alike.
LEADERS = 16_384
#: Bound on hidden values, and on the weights of the last layer: logits stay below 80, so that exp() does not overflow.
BOUND, LAST_BOUND = 4.0, 1.2
SHAPES = {
    "embed": (SLOTS + CLASSES, WIDTH), "place": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH, WIDTH),
    "up": (WIDTH, HIDDEN), "up_bias": (HIDDEN,), "down": (HIDDEN, WIDTH), "last": (WIDTH, CLASSES), "last_bias": (CLASSES,),
}
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


class Vocabulary:
    """What corpus counts tell of symbols: classes, shares within classes, and the class after a symbol as a first guess.

    The first n_ids symbols are subword ids, the rest are frequent words, whose ids are predicted in one step. starts: of
    each symbol, whether it begins a word. A class is a symbol of its own, or a bin of symbols that all begin words, or
    one of ids that all stand within words; so the share of an id may depend on the class before it within its word and
    still be a probability.
    """

    def __init__(self, counts: np.ndarray, starts: np.ndarray, n_ids: int):
        self.n_ids, self.starts = n_ids, starts
        self.smooth = counts.astype(np.float64) + 0.1
        self.order = np.argsort(-self.smooth, kind="stable")
        self.own = np.full(len(counts), -1, np.int32)
        self.own[self.order[:OWN_CLASS]] = np.arange(OWN_CLASS)
        self.leader = np.full(len(counts), -1, np.int32)
        self.leader[self.order[:LEADERS]] = np.arange(min(LEADERS, len(counts)))

    def group(self, company: np.ndarray, first: np.ndarray) -> None:
        """company: leaders x own classes, how often they share a text. first: each symbol's first subword id."""
        m = np.sqrt(company + 1e-9)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        lead = self.order[: len(company)]
        weight = self.smooth[lead] * (company.sum(1) > 0)
        centres = [m[int(np.argmax(weight))]]
        for _ in range(KINDS - 1):  # the next centre is the heaviest that is far from all others
            far = np.min([2 - 2 * m @ c for c in centres], axis=0)
            centres.append(m[int(np.argmax(weight * far))])
        centres = np.array(centres)
        for _ in range(15):
            near = np.argmax(m @ centres.T, 1)
            for k in range(KINDS):
                if (own := near == k).any() and weight[own].sum() > 0:
                    centres[k] = weight[own] @ m[own]
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
        near = np.argmax(m @ centres.T, 1)
        votes = np.zeros((self.n_ids, KINDS))
        np.add.at(votes, (first[lead], near), weight)
        kind = np.argmax(votes, 1)[first]
        kind[lead[weight > 0]] = near[weight > 0]

        self.klass = np.zeros(len(self.smooth), np.int32)
        self.klass[self.order[:OWN_CLASS]] = np.arange(OWN_CLASS)
        self.start_class = np.zeros(CLASSES, bool)
        self.start_class[:OWN_CLASS] = self.starts[self.order[:OWN_CLASS]]
        rest, at = self.order[OWN_CLASS:], OWN_CLASS
        for own, bins, start in [*((rest[self.starts[rest] & (kind[rest] == k)], START_BINS, True) for k in range(KINDS)), (rest[~self.starts[rest]], INNER_BINS, False)]:
            mass = np.cumsum(self.smooth[own])
            if len(own):
                self.klass[own] = at + np.minimum((mass / mass[-1] * bins).astype(np.int32), bins - 1)
            self.start_class[at : at + bins] = start
            at += bins
        self.slot = (SLOTS + self.klass).astype(np.int32)
        self.slot[self.order[:SLOTS]] = np.arange(min(SLOTS, len(self.order)))

    def learn(self, slot_class: np.ndarray, class_id: np.ndarray) -> None:
        """slot_class: how often a class follows an input slot; class_id: how often a subword id follows a class within words."""
        mass = np.bincount(self.klass, self.smooth, CLASSES)
        flat = (mass + 1e-6) / (mass + 1e-6).sum()
        self.prior = np.log((slot_class + 20 * flat) / (slot_class.sum(1, keepdims=True) + 20)).astype(np.float32)
        self.prior[:, mass == 0] = -40  # bins that no symbol fell in
        share = self.smooth / np.maximum(mass, 1e-9)[self.klass]
        self.start_share = np.log(share).astype(np.float32)
        self.inner_share = np.empty(class_id.shape, np.float32)
        of, share = self.klass[: self.n_ids], share[: self.n_ids]
        for k in range(len(class_id)):
            seen = np.bincount(of, class_id[k], CLASSES)
            self.inner_share[k] = np.log((class_id[k] + 20 * share) / (seen[of] + 20))

    def within(self, before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Log-share of symbols within their classes."""
        out = self.start_share[symbols]
        inner = np.flatnonzero(~self.start_class[self.klass[symbols]])
        out[inner] = self.inner_share[self.klass[before[inner]], symbols[inner]]
        return out


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if k in ("embed", "place") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in SHAPES.items()}
    p["up_bias"][:] = 0
    p["last"] *= 0.1
    p["last_bias"][:] = 0
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.ascontiguousarray(flat[at : at + n].reshape(s), dtype=np.float32)
        at += n
    return out


def windows(lengths: np.ndarray):
    """Of sequences laid end to end (lengths with a first token that is given): each window's start, how many tokens of
    the sequence it can read, how many of its targets an earlier window has scored, and its sequence. Each token but the
    first is scored by one window."""
    step = WINDOW - OVERLAP
    targets = lengths - 1
    n = 1 + np.maximum(0, -(-(targets - WINDOW) // step))
    n = np.where(targets > 0, n, 0)
    which = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(lengths) - lengths)[which]
    return begin + k * step, lengths[which] - k * step, np.where(k > 0, OVERLAP, 0), which


def _attend(p, slots):
    x = p["embed"][slots] + p["place"]
    b = len(x)
    qkv = (x.reshape(-1, WIDTH) @ p["qkv"]).reshape(b, WINDOW, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    a = q @ k.transpose(0, 2, 1)
    a *= 1 / np.sqrt(WIDTH)
    np.minimum(a, 60, out=a)
    a += _MASK
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    z = a @ v
    h = x + (z.reshape(-1, WIDTH) @ p["out"]).reshape(x.shape)
    return x, q, k, v, a, z, h


def log_probs(p, prior, slots, at, classes):
    """Natural log-probability of the class after each place. slots: windows x WINDOW; at: flat places; classes: there."""
    h = _attend(p, slots)[-1].reshape(-1, WIDTH)[at]
    u = h @ p["up"]
    u += p["up_bias"]
    np.maximum(u, 0, out=u)
    h += u @ p["down"]
    np.clip(h, -BOUND, BOUND, out=h)
    y = h @ p["last"]
    y += p["last_bias"]
    y += prior[slots.ravel()[at]]
    own = y[np.arange(len(y)), classes]
    np.exp(y, out=y)
    return own - np.log(y @ np.ones(CLASSES, np.float32))


def step(p, prior, slots, at, classes):
    """Mean loss and gradients of one batch."""
    x, q, k, v, a, z, h = _attend(p, slots)
    n, g = len(at), {}
    hs = h.reshape(-1, WIDTH)[at]
    u = np.maximum(hs @ p["up"] + p["up_bias"], 0)
    h2 = np.clip(free := hs + u @ p["down"], -BOUND, BOUND)
    y = h2 @ p["last"]
    y += p["last_bias"]
    y += prior[slots.ravel()[at]]
    own = y[np.arange(n), classes]
    dy = np.exp(y, out=y)
    total = y @ np.ones(CLASSES, np.float32)
    loss = float((np.log(total) - own).mean())
    dy *= (1 / (total * n))[:, None]
    dy[np.arange(n), classes] -= np.float32(1 / n)
    g["last"], g["last_bias"] = h2.T @ dy, dy.sum(0)
    dh2 = (dy @ p["last"].T) * (np.abs(free) < BOUND)
    du = (dh2 @ p["down"].T) * (u > 0)
    g["down"], g["up"], g["up_bias"] = u.T @ dh2, hs.T @ du, du.sum(0)
    dh = np.zeros((h.shape[0] * WINDOW, WIDTH), np.float32)
    dh[at] = dh2 + du @ p["up"].T
    g["out"] = z.reshape(-1, WIDTH).T @ dh
    dz = (dh @ p["out"].T).reshape(z.shape)
    dv = a.transpose(0, 2, 1) @ dz
    ds = dz @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, a)[..., None]
    ds *= a
    ds *= np.float32(1 / np.sqrt(WIDTH))
    dqkv = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, dv], -1).reshape(-1, 3 * WIDTH)
    g["qkv"] = x.reshape(-1, WIDTH).T @ dqkv
    dx = (dh + dqkv @ p["qkv"].T).reshape(x.shape)
    g["place"] = dx.sum(0)
    flat, order = slots.ravel(), np.argsort(slots.ravel(), kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    g["embed"] = (ordered[first], np.add.reduceat(dx.reshape(-1, WIDTH)[order], first, axis=0))
    return loss, g


class Adam:
    def __init__(self, p, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, g, scale: float = 1.0) -> None:
        self.t += 1
        rate = self.rate * scale * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = slice(None)
            if isinstance(d, tuple):  # only the rows that occurred
                at, d = d
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            v = self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * d * d
            self.p[k][at] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        np.clip(self.p["last"], -LAST_BOUND, LAST_BOUND, out=self.p["last"])
        np.clip(self.p["last_bias"], -2, 2, out=self.p["last_bias"])


def batches(ids: list[np.ndarray], vocabulary: Vocabulary, size: int):
    """(slots, places, classes, log-shares within them, sequence of each) of size windows at a time. ids: each with its given first token."""
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(WINDOW + 1, np.int64)])
    start, can, done, which = windows(lengths)
    reach = np.arange(WINDOW)
    for b in range(0, len(start), size):
        s = slice(b, b + size)
        at = start[s, None] + reach
        scored = (reach >= done[s, None]) & (reach + 1 < can[s, None])
        before = at[scored]
        target = flat[before + 1]
        yield vocabulary.slot[flat[at]], np.flatnonzero(scored.ravel()), vocabulary.klass[target], vocabulary.within(flat[before], target), np.repeat(which[s], scored.sum(1))
