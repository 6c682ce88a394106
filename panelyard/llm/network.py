"""A bidirectional gated recurrent network with attention pooling, and its training, in numpy.

Two nets of the same kind are stacked: one reads the characters of a word and gives the word's vector, one reads the
word vectors of a window (with an embedding of frequent words beside) and gives the window's logit. Gates are
min(max(x / 4 + 1 / 2, 0), 1) and candidate states min(max(x, -1), 1): the pieces of sigmoid and tanh that cost no
exponentials, which are most of the time of such a net in numpy.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def init(rng: np.random.Generator, inputs: int, hidden: int) -> Params:
    """Weights of both directions (f, b), of the attention and of the logistic head."""
    p: Params = {}
    for d in "fb":
        p["W" + d] = rng.normal(0, inputs**-0.5, (inputs, 3 * hidden)).astype(np.float32)
        p["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        p["B" + d] = np.zeros(3 * hidden, np.float32)
    p["att"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
    p["out"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
    p["bias"] = np.zeros(1, np.float32)
    return p


def _direction(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (steps, n, h) of one direction over projected inputs x (steps, n, 3h); steps that the mask rules out keep the state."""
    steps, n, h3 = x.shape
    h = h3 // 3
    state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
    for t in range(steps):
        g = state @ u
        zr = _gate(x[t, :, :2 * h] + g[:, :2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.clip(x[t, :, 2 * h:] + r * g[:, 2 * h:], -1, 1)
        new = c + z * (state - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, state)
        if keep is not None:
            keep.append((state, z, r, c, g[:, 2 * h:]))
        out[t] = state = new
    return out


def forward(p: Params, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled states (n, 2h) and logits (n) of inputs projected for both directions."""
    kf, kb = ([], []) if keep is not None else (None, None)
    back = None if mask is None else mask[::-1]
    states = np.concatenate([_direction(xf, p["Uf"], mask, kf), _direction(xb[::-1], p["Ub"], back, kb)[::-1]], axis=2)
    s = states @ p["att"]
    if mask is not None:
        s = np.where(mask, s, -1e9)
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    if keep is not None:
        keep.update(f=kf, b=kb, states=states, a=a, pooled=pooled, mask=mask)
    return pooled, pooled @ p["out"] + p["bias"]


def _stepper(p: Params, d: str, heads: np.ndarray):
    """A function of (input, state) with features leading, for inputs scaled by ``scaled``: it gives the heads of the old state and moves the state on in place."""
    h = p["U" + d].shape[0]
    u = np.ascontiguousarray(np.concatenate([p["U" + d].T * _scale(h), heads]), np.float32)

    def step(x: np.ndarray, state: np.ndarray) -> np.ndarray:
        g = u @ state
        zr = g[:2 * h]
        zr += x[:2 * h]
        zr.clip(0, 1, zr)
        c = zr[h:]
        c *= g[2 * h:3 * h]
        c += x[2 * h:]
        c.clip(-1, 1, c)
        state -= c
        state *= zr[:h]
        state += c
        return g[3 * h:]

    return step


def _scale(h: int) -> np.ndarray:
    return np.array([0.25] * 2 * h + [1.0] * h, np.float32)[:, None]  # of gates; their 1 / 2 goes to the inputs


def scaled(x: np.ndarray) -> np.ndarray:
    """Projected inputs (n, 3h) as ``_stepper`` takes them: features lead."""
    h = x.shape[1] // 3
    return np.ascontiguousarray(x.T) * _scale(h) + np.array([0.5] * 2 * h + [0.0] * h, np.float32)[:, None]


def sliding(p: Params):
    """A function of inputs projected for both directions (words, 3h) and n: scores of all windows of n words in a row.

    Equals ``forward`` without a mask. A window's step t is word t of it, so the inputs of a step are a slice of the
    words; of the states only what attention and head make of them is kept.
    """
    h = p["Uf"].shape[0]
    steppers, last = [], []
    for k, d in enumerate("fb"):
        heads = np.stack([p[w][k * h:k * h + h] for w in ("att", "out")]).astype(np.float32)
        steppers.append(_stepper(p, d, heads))
        last.append(heads)

    def direction(x: np.ndarray, k: int, n: int) -> np.ndarray:
        count = x.shape[1] - n + 1
        state, out = np.zeros((h, count), np.float32), np.empty((n, 2, count), np.float32)
        before = None
        for t in range(n) if k == 0 else reversed(range(n)):
            found = steppers[k](x[:, t:t + count], state)
            if before is not None:
                out[before] = found
            before = t
        np.matmul(last[k], state, out=out[before])
        return out

    def scores(xf: np.ndarray, xb: np.ndarray, n: int) -> np.ndarray:
        both = direction(scaled(xf), 0, n) + direction(scaled(xb), 1, n)
        a = np.exp(both[:, 0] - both[:, 0].max(0))
        return _sigmoid((a * both[:, 1]).sum(0) / a.sum(0) + p["bias"])

    return scores


def pooled_by_table(p: Params):
    """A function of ids (steps, n) and the projected inputs of both directions for each id: pooled states (n, 2h), as ``forward`` has them."""
    h = p["Uf"].shape[0]
    steppers = [_stepper(p, d, p["att"][k * h:k * h + h][None].astype(np.float32)) for k, d in enumerate("fb")]

    def pooled(ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        steps, n = ids.shape
        states = np.empty((steps, 2 * h, n), np.float32)
        for k in range(2):
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if k == 0 else reversed(range(steps)):
                steppers[k](tables[k].take(ids[t], axis=1), state)
                states[t, k * h:k * h + h] = state
        s = np.matmul(p["att"].astype(np.float32), states)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        states *= a[:, None]
        return states.sum(0).T

    return pooled


def _back_direction(dh_all: np.ndarray, u: np.ndarray, kept: list, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    steps, n, h = dh_all.shape
    du, dx, carry = np.zeros_like(u), np.zeros((steps, n, 3 * h), np.float32), np.zeros((n, h), np.float32)
    for t in reversed(range(steps)):
        state, z, r, c, gc = kept[t]
        d = dh_all[t] + carry
        through = np.zeros_like(d)
        if mask is not None:
            through = np.where(mask[t][:, None], 0, d)
            d = np.where(mask[t][:, None], d, 0)
        dc = d * (1 - z) * (np.abs(c) < 1)
        dz = d * (state - c) * (0.25 * ((z > 0) & (z < 1)))
        dr = dc * gc * (0.25 * ((r > 0) & (r < 1)))
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        dg = np.concatenate([dz, dr, dc * r], axis=1)
        du += state.T @ dg
        carry = d * z + dg @ u.T + through
    return du, dx


def backward(p: Params, keep: dict, dlogit: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients, and those of the projected inputs of both directions."""
    a, states, pooled, mask = keep["a"], keep["states"], keep["pooled"], keep["mask"]
    grads: Params = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", dpool, states)
    ds = a * (da - (a * da).sum(0))
    grads["att"] = np.einsum("tn,tnh->h", ds, states)
    dstates = a[:, :, None] * dpool + ds[:, :, None] * p["att"]
    h = p["Uf"].shape[0]
    grads["Uf"], dxf = _back_direction(dstates[:, :, :h], p["Uf"], keep["f"], mask)
    grads["Ub"], dxb = _back_direction(dstates[::-1, :, h:], p["Ub"], keep["b"], None if mask is None else mask[::-1])
    return grads, dxf, dxb[::-1]


def project(p: Params, x: np.ndarray, d: str) -> np.ndarray:
    return x @ p["W" + d] + p["B" + d]


def input_gradients(p: Params, grads: Params, x: np.ndarray, dxf: np.ndarray, dxb: np.ndarray) -> np.ndarray:
    """Adds the gradients of the projections; returns that of the inputs."""
    flat, f, b = x.reshape(-1, x.shape[-1]), dxf.reshape(-1, dxf.shape[-1]), dxb.reshape(-1, dxb.shape[-1])
    grads["Wf"], grads["Wb"], grads["Bf"], grads["Bb"] = flat.T @ f, flat.T @ b, f.sum(0), b.sum(0)
    return (f @ p["Wf"].T + b @ p["Wb"].T).reshape(x.shape)


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g.astype(np.float64)**2).sum() for g in grads.values())))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * np.float32(clip)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
