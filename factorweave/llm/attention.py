"""A small causal self-attention model in numpy, trained by hand-written gradients.

A position is a word, read through its first and its last subword id. From the positions before it
the model predicts the word's class: the most frequent words that are one subword id long are classes
of their own, the others are classed by their last subword id, and the end of a text is a class too.
Inside its class a word has its relative frequency.

Windows of ``2 * STRIDE`` positions overlap by half: a block of STRIDE positions attends to itself
and the block before, causally, so each word is scored once, from STRIDE to 2 * STRIDE words of
context.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

STRIDE, WIDTH, HIDDEN = 16, 16, 32
#: Input classes of subword ids and how many of them rare ids share; words, and classes by last id, that are predicted; how many of those rare ids share.
INPUTS, INPUTS_SHARED, SINGLE, BY_ID, BY_ID_SHARED = 1024, 128, 48, 64, 16
END, OUTPUTS = SINGLE + BY_ID, SINGLE + BY_ID + 1
NEVER, SCALE = np.float32(-1e9), WIDTH**-0.5


def classes_of(counts: np.ndarray, classes: int, shared: int) -> np.ndarray:
    """The class of each id: the most frequent ids singly, the others in ``shared`` runs of about equal weight."""
    order = np.argsort(-counts, kind="stable")
    single = classes - shared
    out = np.zeros(len(counts), np.int32)
    out[order[:single]] = np.arange(min(single, len(counts)))
    rest = order[single:]
    if len(rest):
        weight = np.cumsum(counts[rest] + 1.0)
        out[rest] = single + np.minimum((weight * shared / (weight[-1] + 1)).astype(np.int32), shared - 1)
    return out


class Vocabulary:
    """Input and output classes of words, given as first | last << 16 of their subword ids, which are equal only in words of one id."""

    IDS = 1 << 16

    def __init__(self, read: np.ndarray, alone: np.ndarray, last: np.ndarray):
        """How often each id is a word's first or last one, how often it is a word, and how often the last of a longer word, in the training texts."""
        inputs = classes_of(read, INPUTS, INPUTS_SHARED).astype(np.int64)
        top = np.argsort(-alone, kind="stable")[:SINGLE]
        top = top[alone[top] > 0]
        single = np.full(self.IDS, -1, np.int64)
        single[top] = np.arange(len(top))
        by_last = SINGLE + classes_of(np.where(single < 0, alone, 0) + last, BY_ID, BY_ID_SHARED).astype(np.int64)
        # what a first and a last id add to a word's code, and the code of a word of one id
        self.first, self.last = inputs, inputs << 16 | by_last << 32
        self.one = inputs | inputs << 16 | np.where(single < 0, by_last, single) << 32

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Input classes and output class of each word in one number."""
        first, last = words & 0xFFFF, words >> 16
        return np.where(first == last, self.one.take(first), self.first.take(first) | self.last.take(last))


def shapes() -> dict[str, tuple[int, ...]]:
    d, h = WIDTH, HIDDEN
    return {"E": (INPUTS + 1, d), "L": (INPUTS + 1, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "W1": (d, h), "b1": (h,), "W2": (h, d), "U": (d, OUTPUTS), "c": (OUTPUTS,)}


def fresh(share: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """First parameters, which predict each class by its share of the training words."""
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(s) * (0.3 if k in "EL" else s[0] ** -0.5)).astype(np.float32) for k, s in shapes().items()}
    out["U"] *= 0.1
    out["b1"][:] = 0
    out["c"] = np.log(np.maximum(share, 1e-9)).astype(np.float32)
    return out


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def distance_bias() -> np.ndarray:
    """Bias of query i (of STRIDE) on key j (of 2 * STRIDE): less the farther back, never ahead."""
    back = (STRIDE + np.arange(STRIDE))[:, None] - np.arange(2 * STRIDE)[None, :]
    return np.where(back >= 0, -0.25 * back, NEVER).astype(np.float32)


BIAS = distance_bias()


def blocked(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as arrays of codes: input classes (blocks, STRIDE, 2), target classes (-1: none), whether a block begins a text, and each text's first block (one more at the end)."""
    sizes = np.array([-(-(len(t) + 1) // STRIDE) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = np.full((first[-1] * STRIDE, 2), INPUTS, np.int32)
    y = np.full(first[-1] * STRIDE, -1, np.int32)
    for t, at in zip(texts, first[:-1] * STRIDE):
        n = len(t)
        x[at + 1 : at + 1 + n, 0] = t & 0xFFFF
        x[at + 1 : at + 1 + n, 1] = t >> 16 & 0xFFFF
        y[at : at + n] = t >> 32
        y[at + n] = END
    begins = np.zeros(first[-1], bool)
    begins[first[:-1]] = True
    return x.reshape(-1, STRIDE, 2), y.reshape(-1, STRIDE), begins, first


def exponentials(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - shift) of each row, its sum weighted by weights, and shift: 0 unless sums would come near the range of numbers."""
    weights = np.ones(x.shape[-1], x.dtype) if weights is None else weights
    with np.errstate(over="ignore"):
        own = np.exp(x)
    total = own @ weights
    if total.min(initial=1) > 1e-20 and total.max(initial=1) < 1e20:
        return own, total, 0.0
    shift = x.max(-1)
    own = np.exp(x - shift[..., None])
    return own, own @ weights, shift


def with_before(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """e @ w of each block's keys, the block before and itself; a view, as each block's rows are used twice. Nothing is before the first."""
    rows = np.empty((STRIDE + len(e), WIDTH), e.dtype)
    rows[:STRIDE] = 0
    np.matmul(e, w, out=rows[STRIDE:])
    return as_strided(rows, (len(e) // STRIDE, 2 * STRIDE, WIDTH), (STRIDE * rows.strides[0], *rows.strides), writeable=False)


def folded(rows: np.ndarray) -> np.ndarray:
    """What with_before() has spread, added up again per position."""
    out = rows[:, STRIDE:].copy()
    out[:-1] += rows[1:, :STRIDE]
    return out.reshape(-1, WIDTH)


def attend(q: np.ndarray, k: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each query, already scaled, on its keys, and what they have to be divided by."""
    scores = q @ k.transpose(0, 2, 1)
    scores += BIAS
    scores[begins, :, :STRIDE] = NEVER  # nothing stands before a text
    return exponentials(scores)[:2]


def read(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out = p["E"].take(x[..., 0].ravel(), axis=0)
    out += p["L"].take(x[..., 1].ravel(), axis=0)
    return out


def class_weights(p: dict[str, np.ndarray], logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(c) to weigh exponentials by, so that c is not added to all logits, and c for the logits that are looked up; where c is too uneven for that, logits get it."""
    c = p["c"] - p["c"].max()
    if c.min() < -30:
        logits += c
        c = np.zeros_like(c)
    return np.exp(c), c


def log_probabilities(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log probability of each target class, 0 where there is none."""
    e = read(p, x)
    weights, total = attend((e @ (p["Q"] * SCALE)).reshape(-1, STRIDE, WIDTH), with_before(e, p["K"]), begins)
    h = weights @ with_before(e, p["V"])
    h /= total[..., None]
    z = h.reshape(-1, WIDTH) @ p["O"]
    z += e
    hidden = z @ p["W1"]
    hidden += p["b1"]
    np.maximum(hidden, 0, out=hidden)
    z += hidden @ p["W2"]
    logits = z @ p["U"]
    by_class, c = class_weights(p, logits)
    target = y.ravel()
    of = np.maximum(target, 0)
    wanted = logits.ravel().take(np.arange(0, logits.size, OUTPUTS) + of) + c.take(of)
    _, total, shift = exponentials(logits, by_class)
    return np.where(target >= 0, wanted - shift - np.log(total), 0).reshape(y.shape)


#: Where the rows of E and L are in the arrays as vectors.
PLACES = np.arange((INPUTS + 1) * WIDTH).reshape(-1, WIDTH)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the targets and its gradients."""
    two = lambda t: t.reshape(-1, WIDTH)
    ex = read(p, x)
    q, k, v = (ex @ (p["Q"] * SCALE)).reshape(-1, STRIDE, WIDTH), with_before(ex, p["K"]), with_before(ex, p["V"])
    a, total = attend(q, k, begins)
    a *= (1 / total)[..., None]
    h = two(a @ v)
    z = h @ p["O"]
    z += ex
    r = z @ p["W1"]
    r += p["b1"]
    np.maximum(r, 0, out=r)
    m = r @ p["W2"]
    m += z
    logits = m @ p["U"]
    by_class, _ = class_weights(p, logits)
    g, total, _ = exponentials(logits, by_class)
    target = y.ravel()
    there = target >= 0
    of = np.maximum(target, 0)
    n, at, each = max(1, int(there.sum())), np.arange(0, g.size, OUTPUTS) + of, g.ravel()
    wanted, weight = each.take(at), by_class.take(of)
    loss = -float(np.log(np.maximum(wanted * weight / total, 1e-20)) @ there) / n
    each[at] = wanted - total / weight  # a row of g is its gradient now, but for by_class and the position's share
    share = (there / (total * n)).astype(g.dtype)
    out = {"U": (m * share[:, None]).T @ g * by_class, "c": share @ g * by_class}
    dz = g @ (p["U"] * by_class).T
    dz *= share[:, None]
    dr = dz @ p["W2"].T
    dr *= r > 0
    out |= {"W2": r.T @ dz, "W1": z.T @ dr, "b1": np.ones(len(dr), dr.dtype) @ dr}
    dz += dr @ p["W1"].T
    out["O"] = h.T @ dz
    dh = dz @ p["O"].T
    along = np.einsum("ij,ij->i", dh, h).reshape(-1, STRIDE, 1)
    dh = dh.reshape(q.shape)
    ds = dh @ v.transpose(0, 2, 1)
    ds -= along
    ds *= a
    dq, dk, dv = two(ds @ k), folded(ds.transpose(0, 2, 1) @ q), folded(a.transpose(0, 2, 1) @ dh)
    out |= {"Q": ex.T @ dq * SCALE, "K": ex.T @ dk, "V": ex.T @ dv}
    dz += dq @ (p["Q"] * SCALE).T
    dz += dk @ p["K"].T
    dz += dv @ p["V"].T
    for name, of in (("E", x[..., 0]), ("L", x[..., 1])):
        out[name] = np.zeros(p[name].shape, dz.dtype)
        np.add.at(out[name].ravel(), PLACES.take(of.ravel(), axis=0).ravel(), dz.ravel())
    return loss, out


class Adam:
    """Steps for the parameters p, whose arrays become views of one vector."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.steps, self.all = rate, 0, np.concatenate([x.ravel() for x in p.values()])
        self.names, at = list(p), 0
        for k, x in p.items():
            p[k], at = self.all[at : at + x.size].reshape(x.shape), at + x.size
        self.m, self.v = np.zeros_like(self.all), np.zeros_like(self.all)

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        root = (1 - 0.99**self.steps) ** 0.5
        # m and v are kept as 10 and 100 times what they are
        rate, least = self.rate * root / (1 - 0.9**self.steps), 1e-7 * root
        x, m, v = np.concatenate([g[k].ravel() for k in self.names]), self.m, self.v
        m *= 0.9
        m += x
        v *= 0.99
        x *= x
        v += x
        np.sqrt(v, out=x)
        x += least
        np.divide(m, x, out=x)
        x *= rate
        self.all -= x
