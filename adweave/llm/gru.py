"""A bidirectional gated recurrent network with attention pooling, in numpy, with its gradients."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def init(n_words: int, n_chars: int, dim: int, hidden: int, seed: int = 5) -> Params:
    rng = np.random.Generator(np.random.PCG64(seed))
    u = lambda *s, scale: rng.uniform(-scale, scale, s).astype(np.float32)
    p = {"word": u(n_words, dim, scale=0.3), "char": u(n_chars, dim, scale=0.3)}
    for d in "fb":
        p["W" + d] = u(2 * dim, 3 * hidden, scale=0.5)
        p["U" + d] = u(hidden, 3 * hidden, scale=0.5)
        p["c" + d] = np.zeros(3 * hidden, np.float32)
    p["att"] = u(2 * hidden, scale=0.5)
    p["out"] = u(2 * hidden, scale=0.5)
    p["bias"] = np.zeros(1, np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction. x: [time, batch, 3 hidden] inputs, projected; keep: gets each step's gates."""
    hidden = u.shape[0]
    h = np.zeros((x.shape[1], hidden), x.dtype)
    states = np.empty((x.shape[0], x.shape[1], hidden), x.dtype)
    for t in range(x.shape[0]):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        z, r, gn = zr[:, :hidden], zr[:, hidden:], g[:, 2 * hidden :]
        n = np.tanh(x[t, :, 2 * hidden :] + r * gn)
        if keep is not None:
            keep.append((h, z, r, gn, n))
        h = n + z * (h - n)
        states[t] = h
    return states


def logits(p: Params, xf: np.ndarray, xb: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window. xf, xb: [time, batch, 3 hidden]; real: [time, batch], False at padding."""
    kf, kb = ([], []) if keep is not None else (None, None)
    s = np.concatenate([_run(xf, p["Uf"], kf), _run(xb[::-1], p["Ub"], kb)[::-1]], axis=2)
    e = np.where(real, s @ p["att"], -1e9)
    a = np.exp(e - e.max(0))
    a *= real
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * s).sum(0)
    if keep is not None:
        keep |= {"kf": kf, "kb": kb, "s": s, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0]


def _back(dstates: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    hidden = u.shape[0]
    dx = np.empty((*dstates.shape[:2], 3 * hidden), dstates.dtype)
    du = np.zeros_like(u)
    dh = np.zeros(dstates.shape[1:], dstates.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, gn, n = kept[t]
        dh = dh + dstates[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return dx, du


def gradients(p: Params, words: np.ndarray, grams: np.ndarray, gram_of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Weighted logistic loss of windows and its gradients.

    words: [time, batch] rows of p["word"], 0 at padding; grams: n-gram rows of p["char"] of
    the distinct words, one after another; gram_of: where each word's n-grams begin, by word.
    """
    distinct, at = np.unique(words, return_inverse=True)
    at = at.reshape(words.shape)
    counts = gram_of[distinct + 1] - gram_of[distinct]
    pick = np.concatenate([grams[gram_of[w] : gram_of[w + 1]] for w in distinct]) if len(distinct) else grams[:0]
    owner = np.repeat(np.arange(len(distinct)), counts)
    dim = p["word"].shape[1]
    chars = np.zeros((len(distinct), dim), p["word"].dtype)
    np.add.at(chars, owner, p["char"][pick])
    share = 1 / np.maximum(counts, 1)[:, None].astype(chars.dtype)
    e = np.concatenate([p["word"][distinct], chars * share], axis=1)
    real = words > 0
    xf, xb = ((e @ p["W" + d] + p["c" + d])[at] for d in "fb")
    keep: dict = {}
    out = logits(p, xf, xb, real, keep)
    q = sigmoid(out)
    loss = float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum())
    d = (weight * (q - y)).astype(e.dtype)
    s, a, pooled = keep["s"], keep["a"], keep["pooled"]
    g: Params = {"out": pooled.T @ d, "bias": np.array([d.sum()], e.dtype)}
    dpool = d[:, None] * p["out"]
    da = (s * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    g["att"] = np.einsum("tb,tbh->h", de, s)
    ds = a[:, :, None] * dpool + de[:, :, None] * p["att"]
    hidden = p["Uf"].shape[0]
    dxf, g["Uf"] = _back(ds[:, :, :hidden], p["Uf"], keep["kf"])
    dxb, g["Ub"] = _back(ds[::-1, :, hidden:], p["Ub"], keep["kb"])
    dxb = dxb[::-1]
    demb = np.zeros_like(e)
    for name, dx in (("f", dxf), ("b", dxb)):
        per = np.zeros((len(distinct), dx.shape[2]), e.dtype)
        np.add.at(per, at.ravel(), dx.reshape(-1, dx.shape[2]))
        g["c" + name] = per.sum(0)
        g["W" + name] = e.T @ per
        demb += per @ p["W" + name].T
    g["word"] = np.zeros_like(p["word"])
    g["word"][distinct] = demb[:, :dim]
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], pick, (demb[:, dim:] * share)[owner])
    return loss, g


class Adam:
    def __init__(self, p: Params, rate: float = 0.01) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] ** 2 - self.v[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
