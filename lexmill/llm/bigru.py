"""A bidirectional GRU with attention pooling over word and character inputs, in numpy.

A word's input is its own vector, if the vocabulary has it, beside the sum of
the vectors of its character n-grams. Windows of ``WINDOW`` words go through a
GRU in either direction; attention weighs the states into one vector, which
gives a logit. Arrays of states are (step, window, unit).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WINDOW, STRIDE = 64, 32
GRAMS = (4, 5, 6)
_P = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of all character n-grams of the words, with their edges marked."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(m) for m in marked])
    ends = np.cumsum(lens)
    of = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))
    hashes, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for k in range(max(GRAMS)):
        m = len(codes) - k
        if m <= 0:
            break
        h = (h[:m] ^ codes[k:]) * _P
        h ^= h >> np.uint64(29)
        if k + 1 in GRAMS:
            ok = left[:m] > k
            hashes.append(h[ok] + np.uint64(k))
            owners.append(of[:m][ok])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class Net:
    """Vocabularies and parameters; small enough to travel with a task."""

    words: dict[str, int]
    grams: np.ndarray  # sorted hashes
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word table (the last is for others), known grams and the words they are of."""
        own = np.array([self.words.get(w, len(self.words)) for w in words], np.int64)
        h, of = gram_hashes(words)
        if not len(self.grams):
            return own, np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        known = self.grams[at] == h
        return own, at[known], of[known]

    def inputs(self, own: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        chars = np.zeros((len(own), self.p["chars"].shape[1]), np.float32)
        np.add.at(chars, of, self.p["chars"][grams])
        return np.concatenate([self.p["words"][own], chars], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs times the input weights of both directions, plus their biases."""
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], 1)


def new_net(words: dict[str, int], word_prior: np.ndarray, grams: np.ndarray, gram_prior: np.ndarray, dim: int = 6, units: int = 8, seed: int = 5) -> Net:
    """Random parameters; the first unit of a vector starts at its log odds."""
    r = np.random.default_rng(seed)

    def rand(*shape: int, scale: float) -> np.ndarray:
        return (r.standard_normal(shape) * scale).astype(np.float32)

    net = Net(words, grams)
    w, c = rand(len(words) + 1, dim, scale=0.05), rand(max(1, len(grams)), dim, scale=0.05)
    w[:-1, 0], w[-1] = word_prior, 0
    if len(grams):
        c[:, 0] = gram_prior * 0.5
    net.p = {"words": w, "chars": c, "att": rand(2 * units, units, scale=0.3), "att_b": np.zeros(units, np.float32), "att_v": rand(units, scale=0.3), "out": rand(2 * units, scale=0.3), "out_b": np.full(1, -1.0, np.float32)}
    for d in "fb":
        net.p |= {f"w{d}": rand(2 * dim, 3 * units, scale=0.3), f"b{d}": np.zeros(3 * units, np.float32), f"u{d}": rand(units, 3 * units, scale=0.3)}
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(px: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """States of one direction. px: (T, n, 3H), mask: (T, n, 1)."""
    steps, n, h3 = px.shape
    k = h3 // 3
    h = np.zeros((n, k), np.float32)
    states = np.empty((steps, n, k), np.float32)
    kept = []
    for t in range(steps):
        zr = _sigmoid(px[t, :, : 2 * k] + h @ u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(px[t, :, 2 * k :] + (r * h) @ u[:, 2 * k :])
        new = h + mask[t] * z * (c - h)
        if keep:
            kept.append((h, z, r, c))
        states[t] = h = new
    return states, kept


def _gru_back(d: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, from those of the states."""
    k = u.shape[0]
    dpx, du = np.empty((*d.shape[:2], 3 * k), np.float32), np.zeros_like(u)
    dh = np.zeros(d.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, c = kept[t]
        dn = dh + d[t]
        m = dn * mask[t]
        dc = m * z * (1 - c * c)
        dz = m * (c - h) * z * (1 - z)
        drh = dc @ u[:, 2 * k :].T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        dpx[t] = np.concatenate([dzr, dc], 1)
        du[:, : 2 * k] += h.T @ dzr
        du[:, 2 * k :] += (r * h).T @ dc
        dh = dn - m * z + drh * r + dzr @ u[:, : 2 * k].T
    return dpx, du


def windows_of(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, words) of all overlapping windows of texts of these many words, one at least each."""
    count = 1 + np.maximum(0, -(-(lens - WINDOW) // STRIDE))
    of = np.repeat(np.arange(len(lens)), count)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return of, start, np.clip(lens[of] - start, 0, WINDOW)


def forward(net: Net, table: np.ndarray, at: np.ndarray, n: np.ndarray, keep: bool = False):
    """Logits of windows. table: projected inputs by word; at: (n, WINDOW) rows of it; n: words in the window."""
    steps = max(1, int(n.max(initial=0)))
    k3 = table.shape[1] // 2
    px = table[at[:, :steps].T]
    mask = (np.arange(steps)[:, None] < n[None, :])[..., None].astype(np.float32)
    f, kf = _gru(px[..., :k3], mask, net.p["uf"], keep)
    b, kb = _gru(px[::-1, :, k3:], mask[::-1], net.p["ub"], keep)
    h = np.concatenate([f, b[::-1]], 2)
    u = np.tanh(h @ net.p["att"] + net.p["att_b"])
    e = np.where(mask[..., 0] > 0, u @ net.p["att_v"], -1e9)
    a = np.exp(e - e.max(0)) * mask[..., 0]
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tn,tnk->nk", a, h)
    logit = pooled @ net.p["out"] + net.p["out_b"][0]
    return (logit, (mask, kf, kb, h, u, a, pooled)) if keep else logit


def gradients(net: Net, x: np.ndarray, lookup: tuple, at: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted logistic loss of the windows."""
    p = net.p
    logit, (mask, kf, kb, h, u, a, pooled) = forward(net, net.projected(x), at, n, keep=True)
    steps = len(mask)
    dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ dl, "out_b": dl.sum(keepdims=True)}
    dpool = dl[:, None] * p["out"]
    da = np.einsum("nk,tnk->tn", dpool, h)
    de = a * (da - (a * da).sum(0))
    dpre = (de[..., None] * p["att_v"]) * (1 - u * u)
    g |= {"att_v": np.einsum("tn,tnk->k", de, u), "att": np.einsum("tnh,tnk->hk", h, dpre), "att_b": dpre.sum((0, 1))}
    dh = a[..., None] * dpool + dpre @ p["att"].T
    k = p["uf"].shape[0]
    df, g["uf"] = _gru_back(dh[..., :k], kf, mask, p["uf"])
    db, g["ub"] = _gru_back(dh[::-1, :, k:], kb, mask[::-1], p["ub"])
    rows = at[:, :steps].T.ravel()
    live = np.flatnonzero(mask[..., 0].ravel() > 0)
    rows = rows[live]
    dx = np.zeros_like(x)
    for d, dpx in (("f", df), ("b", db[::-1])):
        flat = dpx.reshape(-1, dpx.shape[2])[live]
        per = np.zeros((len(x), flat.shape[1]), np.float32)
        np.add.at(per, rows, flat)
        g |= {f"w{d}": x.T @ per, f"b{d}": per.sum(0)}
        dx += per @ p[f"w{d}"].T
    own, grams, of = lookup
    dim = p["words"].shape[1]
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], own, dx[:, :dim])
    g["words"][-1] = 0
    np.add.at(g["chars"], grams, dx[of, dim:])
    return g


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * d * d
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
