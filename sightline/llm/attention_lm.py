"""A small causal self-attention language model in numpy, over subword ids.

One layer of masked attention with a residual feeds a two-step softmax: first the class of the next subword,
then the subword within its class.  Each class has the same number of subwords, so scoring one token costs
``classes + members`` logits instead of the whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES, MEMBERS = 32, 32
#: Subword ids, the end of a text included; the end also stands before the first subword.
VOCABULARY = CLASSES * MEMBERS
END = VOCABULARY - 1
WIDTH = 24
#: Tokens of a window, and how far windows are apart; a token is scored in the first window that holds it.
CONTEXT, STRIDE = 24, 20
BATCH = 512
#: Logits stop here, so that single precision holds their exponentials; no trained model comes near it.
LIMIT = np.float32(60)

Weights = dict[str, np.ndarray]


def initial(class_of: np.ndarray, counts: np.ndarray, seed: int = 7) -> Weights:
    """Small random weights; biases give the corpus frequencies of classes and of subwords in their class."""
    rng = np.random.default_rng(seed)
    d = WIDTH

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    mass = np.zeros((CLASSES, MEMBERS))
    mass[class_of, member_of(class_of)] = counts + 0.5
    return {
        "E": normal(VOCABULARY, d, scale=0.3), "P": normal(CONTEXT, d, scale=0.1), "Q": normal(d, d, scale=0.25), "K": normal(d, d, scale=0.25),
        "V": normal(d, d, scale=0.25), "O": normal(d, d, scale=0.25), "C": normal(d, CLASSES, scale=0.1), "M": normal(CLASSES, d, MEMBERS, scale=0.1),
        "c": np.log(mass.sum(1) / mass.sum()).astype(np.float32), "m": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    }


def member_of(class_of: np.ndarray) -> np.ndarray:
    """The place of each subword in its class, in the order of the ids."""
    order = np.argsort(class_of, kind="stable")
    place = np.empty(len(class_of), np.int64)
    place[order] = np.arange(len(class_of)) % MEMBERS
    return place


@dataclass
class Windows:
    """Windows over token streams: inputs, targets, and which targets count here."""

    inputs: np.ndarray
    targets: np.ndarray
    counted: np.ndarray
    text: np.ndarray  # of each window

    def __len__(self) -> int:
        return len(self.inputs)


def windows(ids: np.ndarray, first: np.ndarray) -> Windows:
    """Overlapping windows over the texts ``ids[first[i]:first[i + 1]]``, each of which ends with END."""
    sizes = np.diff(first)
    number = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - CONTEXT) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), number)
    place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    at = place[:, None] * STRIDE + np.arange(CONTEXT)[None, :]
    inside = at < sizes[text][:, None]
    flat = np.minimum(first[text][:, None] + at, max(0, len(ids) - 1))
    targets = np.where(inside, ids[flat], END)
    inputs = np.where(at > 0, ids[np.maximum(flat - 1, 0)], END)
    counted = inside & ((at >= place[:, None] * STRIDE + CONTEXT - STRIDE) | (place[:, None] == 0))
    return Windows(inputs, targets, counted, text)


_FUTURE = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)


def _attend(w: Weights, inputs: np.ndarray, keep_weights: bool = True) -> dict[str, np.ndarray]:
    x = w["E"][inputs] + w["P"]
    q, k, v = x @ w["Q"], x @ w["K"], x @ w["V"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(WIDTH))
    np.minimum(a, LIMIT, out=a)
    a += _FUTURE
    np.exp(a, out=a)
    mass = _row_sums(a)[..., None]
    z = (a @ v) / mass
    if keep_weights:
        a /= mass
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "z": z, "h": x + z @ w["O"]}


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis; for short rows a product with ones is much faster than a reduction."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    np.minimum(logits, LIMIT, out=logits)
    logits -= np.log(_row_sums(np.exp(logits)))[:, None]
    return logits


def _chosen(logits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The log-softmax of one column of each row."""
    np.minimum(logits, LIMIT, out=logits)
    picked = logits[rows, columns]
    np.exp(logits, out=logits)
    return picked - np.log(_row_sums(logits))


def _by_class(classes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(classes.astype(np.int8), kind="stable")
    edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    return [(c, order[edges[c] : edges[c + 1]]) for c in range(CLASSES) if edges[c + 1] > edges[c]]


def log_probabilities(w: Weights, class_of: np.ndarray, batch: Windows) -> np.ndarray:
    """Natural log-probability of each counted target, in the order of ``batch.counted``."""
    member = member_of(class_of)
    h = _attend(w, batch.inputs, keep_weights=False)["h"][batch.counted]
    target = batch.targets[batch.counted]
    classes = class_of[target]
    rows = np.arange(len(target))
    out = _chosen(h @ w["C"] + w["c"], rows, classes)
    for c, at in _by_class(classes):
        out[at] += _chosen(h[at] @ w["M"][c] + w["m"][c], rows[: len(at)], member[target[at]])
    return out


def gradient(w: Weights, class_of: np.ndarray, member: np.ndarray, batch: Windows) -> tuple[float, Weights]:
    """Mean loss of the counted targets, and its gradient."""
    s = _attend(w, batch.inputs)
    h, target = s["h"][batch.counted], batch.targets[batch.counted]
    classes, n = class_of[target], max(1, len(target))
    rows = np.arange(len(target))
    g = {k: np.zeros_like(v) for k, v in w.items()}
    logp = _log_softmax(h @ w["C"] + w["c"])
    loss = -float(logp[rows, classes].sum())
    d = np.exp(logp)
    d[rows, classes] -= 1
    g["C"], g["c"], dh = h.T @ d, d.sum(0), d @ w["C"].T
    for c, at in _by_class(classes):
        logp = _log_softmax(h[at] @ w["M"][c] + w["m"][c])
        chosen = member[target[at]]
        loss -= float(logp[np.arange(len(at)), chosen].sum())
        d = np.exp(logp)
        d[np.arange(len(at)), chosen] -= 1
        g["M"][c], g["m"][c] = h[at].T @ d, d.sum(0)
        dh[at] += d @ w["M"][c].T
    full = np.zeros_like(s["h"])
    full[batch.counted] = dh
    flat = lambda t: t.reshape(-1, WIDTH)
    g["O"] = flat(s["z"]).T @ flat(full)
    dz = full @ w["O"].T
    da = dz @ s["v"].transpose(0, 2, 1)
    da = s["a"] * (da - (da * s["a"]).sum(-1, keepdims=True)) * np.float32(1 / np.sqrt(WIDTH))
    dq, dk, dv = da @ s["k"], da.transpose(0, 2, 1) @ s["q"], s["a"].transpose(0, 2, 1) @ dz
    dx = full + dq @ w["Q"].T + dk @ w["K"].T + dv @ w["V"].T
    for name, part in (("Q", dq), ("K", dk), ("V", dv)):
        g[name] = flat(s["x"]).T @ flat(part)
    g["P"] = dx.sum(0)
    np.add.at(g["E"], batch.inputs.reshape(-1), flat(dx))
    return loss / n, {k: v / np.float32(n) for k, v in g.items()}


def train(w: Weights, class_of: np.ndarray, data: Windows, steps: int, size: int = 64, rate: float = 0.015, seed: int = 7) -> Weights:
    """Adam with a rate that falls linearly, over shuffled windows."""
    rng = np.random.default_rng(seed)
    member = member_of(class_of)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1 if len(data) else 1):
        while len(order) < size:
            order = np.concatenate([order, rng.permutation(len(data))])
        pick, order = order[:size], order[size:]
        _, g = gradient(w, class_of, member, Windows(data.inputs[pick], data.targets[pick], data.counted[pick], data.text[pick]))
        pace = np.float32(rate * (1 - (step - 1) / steps))
        for k in w:
            mean[k] += np.float32(0.1) * (g[k] - mean[k])
            square[k] += np.float32(0.01) * (g[k] ** 2 - square[k])
            w[k] = w[k] - pace * (mean[k] / np.float32(1 - 0.9**step)) / (np.sqrt(square[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return w


def train_stream(
    w: Weights, class_of: np.ndarray, ids: np.ndarray, first: np.ndarray, size: int = 64, rate: float = 0.004, piece: int = 1 << 20,
) -> Weights:
    """One pass of Adam over every window of the texts, ``piece`` ids at a time; a text across pieces is read as two."""
    for lo in range(0, len(ids), piece):
        hi = min(lo + piece, len(ids))
        inner = first[(first > lo) & (first < hi)]
        data = windows(ids[lo:hi], np.concatenate([[lo], inner, [hi]]) - lo)
        w = train(w, class_of, data, -(-len(data) // size), size, rate)
    return w


def token_scores(w: Weights, class_of: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each id of the texts, their ends included."""
    found = [np.zeros(0)]
    for lo in range(0, len(first) - 1, 256):  # windows of a few texts at a time
        hi = min(lo + 256, len(first) - 1)
        data = windows(ids[first[lo] : first[hi]], first[lo : hi + 1] - first[lo])
        for at in range(0, len(data), BATCH):
            part = slice(at, at + BATCH)
            found.append(log_probabilities(w, class_of, Windows(data.inputs[part], data.targets[part], data.counted[part], data.text[part])))
    return np.concatenate(found)  # windows follow each other, and each counts the ids after those of the one before


def score(w: Weights, class_of: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text, its end included."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(owner, token_scores(w, class_of, ids, first), len(first) - 1)
