"""Dense algebra of the model on batches of rows: forward and backward of each part, in double precision."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def glorot(rng: np.random.Generator, out: int, inp: int) -> np.ndarray:
    bound = np.sqrt(6.0 / (inp + out))
    return rng.uniform(-bound, bound, (out, inp))


class Wide:
    """Rows of which most columns are written out and the others, very many, are given where they are not zero: (row, column, value), by row."""

    def __init__(self, dense: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        self.dense, self.row, self.column, self.value = dense, row, column, value

    def __len__(self) -> int:
        return len(self.dense)

    def __getitem__(self, rows: np.ndarray) -> Wide:
        starts = np.searchsorted(self.row, np.arange(len(self.dense) + 1))
        first, count = starts[:-1][rows], np.diff(starts)[rows]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return Wide(self.dense[rows], np.repeat(np.arange(len(count)), count), self.column[at], self.value[at])

    def between(self, low: int, high: int) -> Wide:
        """The columns from low up to high alone, counted from low, without the dense ones."""
        own = (self.column >= low) & (self.column < high)
        return Wide(self.dense[:, :0], self.row[own], self.column[own] - low, self.value[own])


class Rowwise:
    """A gradient that is zero but for some rows of its parameter."""

    def __init__(self, at: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at = at[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        self.at, self.rows = at[new], np.add.reduceat(rows[order], new) if len(new) else rows

    def __add__(self, other: Rowwise) -> Rowwise:
        return Rowwise(np.r_[self.at, other.at], np.concatenate([self.rows, other.rows]))

    def full(self, shape: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(shape)
        out[self.at] = self.rows
        return out


def encode(p: Params, name: str, x: np.ndarray, few: Wide | None = None) -> np.ndarray:
    """A linear map of features; those of `few` gather the rows of their columns."""
    out = linear(p, name, x)
    if few is not None and len(few.row):
        new = np.flatnonzero(np.r_[True, few.row[1:] != few.row[:-1]])
        out[few.row[new]] += np.add.reduceat(p[f"{name}.E"][few.column] * few.value[:, None], new)
    return out


def encode_grads(name: str, x: np.ndarray, few: Wide | None, g: np.ndarray) -> dict[str, np.ndarray | Rowwise]:
    grads: dict[str, np.ndarray | Rowwise] = linear_grads(name, x, g)
    if few is not None and len(few.row):
        grads[f"{name}.E"] = Rowwise(few.column, g[few.row] * few.value[:, None])
    return grads


def init(raw: dict[str, tuple[int, int]], edges: list[tuple[str, str, str]], target: str, channels: int, layers: int, hidden: int, outputs: int, seed: int = 42) -> Params:
    """Parameters by name. raw: dense and sparse width of each node type's features, the latter a row each of enc.<type>.E; edges: (name, source type, destination type)."""
    rng = np.random.default_rng(seed)
    p: Params = {}

    def linear(name: str, out: int, inp: int) -> None:
        p[f"{name}.W"], p[f"{name}.b"] = glorot(rng, out, inp), np.zeros(out)

    for t, (width, many) in raw.items():
        width = max(1, width)
        both = glorot(rng, channels, width + many)
        p[f"enc.{t}.W"], p[f"enc.{t}.b"] = both[:, :width], np.zeros(channels)
        if many:
            p[f"enc.{t}.E"] = np.ascontiguousarray(both[:, width:].T)
    for layer in range(layers):
        for t in raw:
            linear(f"l{layer}.self.{t}", channels, channels)
            p[f"l{layer}.bias.{t}"] = np.zeros(channels)
        for name, _, _ in edges:
            linear(f"l{layer}.neigh.{name}", channels, channels)
    linear("head.1", hidden, channels)
    linear("head.2", outputs, hidden)
    return p


def linear(p: Params, name: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"{name}.W"].T + p[f"{name}.b"]


def linear_grads(name: str, x: np.ndarray, g: np.ndarray) -> Params:
    return {f"{name}.W": g.T @ x, f"{name}.b": g.sum(axis=0)}


def sage(p: Params, layer: int, node: str, own: np.ndarray, means: dict[str, np.ndarray], relu: bool) -> np.ndarray:
    """Own and neighbour projections and a bias; nodes without neighbours get the projection's bias of a zero mean too."""
    out = linear(p, f"l{layer}.self.{node}", own) + p[f"l{layer}.bias.{node}"]
    for edge, m in means.items():
        out = out + linear(p, f"l{layer}.neigh.{edge}", m)
    return np.maximum(out, 0) if relu else out


def sage_back(p: Params, layer: int, node: str, own: np.ndarray, means: dict[str, np.ndarray], out: np.ndarray, g: np.ndarray, relu: bool) -> tuple[np.ndarray, dict[str, np.ndarray], Params]:
    """Gradients of own features, of each mean, and of parameters."""
    if relu:
        g = g * (out > 0)
    grads = linear_grads(f"l{layer}.self.{node}", own, g) | {f"l{layer}.bias.{node}": g.sum(axis=0)}
    back = {}
    for edge, m in means.items():
        grads |= linear_grads(f"l{layer}.neigh.{edge}", m, g)
        back[edge] = g @ p[f"l{layer}.neigh.{edge}.W"]
    return g @ p[f"l{layer}.self.{node}.W"], back, grads


def drop_mask(ids: np.ndarray, width: int, rate: float, seed: int) -> np.ndarray:
    """Inverted dropout that depends on the row's id and the seed, whatever the batch."""
    if rate <= 0:
        return np.ones((len(ids), width))
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return (x.astype(np.float64) / 2.0**64 >= rate) / (1 - rate)


def head(p: Params, h: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(logits, hidden after ReLU and dropout)."""
    z = np.maximum(linear(p, "head.1", h), 0)
    z = z if mask is None else z * mask
    return linear(p, "head.2", z), z


def head_back(p: Params, h: np.ndarray, z: np.ndarray, mask: np.ndarray | None, g: np.ndarray) -> tuple[np.ndarray, Params]:
    grads = linear_grads("head.2", z, g)
    gz = (g @ p["head.2.W"]) * (z > 0)
    gz = gz if mask is None else gz * mask
    return gz @ p["head.1.W"], grads | linear_grads("head.1", h, gz)


def loss(task: str, logits: np.ndarray, y: np.ndarray, n: int, pos_weight: float = 1.0, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(sum of losses / n, its gradient by logits), n being the number of rows that the mean is over."""
    if task == "multiclass_classification":
        at = y.astype(int)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
        w = np.ones(len(y)) if weights is None else weights[at]
        g = prob.copy()
        g[np.arange(len(y)), at] -= 1
        return float(-(w * np.log(prob[np.arange(len(y)), at])).sum() / n), g * w[:, None] / n
    x = logits[:, 0]
    if task == "regression":
        return float(((x - y) ** 2).sum() / n), (2 * (x - y) / n)[:, None]
    w = np.where(y > 0.5, pos_weight, 1.0)
    row = w * (-y * x + np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0))
    return float(row.sum() / n), (w * (1 / (1 + np.exp(-x)) - y) / n)[:, None]


def scored(task: str, logits: np.ndarray) -> np.ndarray:
    """A probability, a value, or a class."""
    if task == "multiclass_classification":
        return logits.argmax(axis=1).astype(float)
    return logits[:, 0] if task == "regression" else 1 / (1 + np.exp(-logits[:, 0]))


def metrics(task: str, ids: np.ndarray, score: np.ndarray, y: np.ndarray, classes: int) -> dict[str, float]:
    """What functions.metrics computes over tables, for rows at hand."""
    n = len(y)
    if task == "regression":
        e, tot = score - y, float((y * y).sum() - n * y.mean() ** 2) if n else 0.0
        return {"rmse": float(np.sqrt((e * e).mean())) if n else 0.0, "mae": float(np.abs(e).mean()) if n else 0.0, "r2": float(1 - (e * e).sum() / tot) if tot > 1e-12 else 0.0}
    ratio = lambda a, b: float(a / b) if b else 0.0
    if task == "multiclass_classification":
        p, y = score.astype(int), y.astype(int)
        f1 = [ratio(2 * ((p == c) & (y == c)).sum(), (p == c).sum() + (y == c).sum()) for c in range(classes)]
        return {"accuracy": ratio((p == y).sum(), n), "macro_f1": sum(f1) / classes}
    pos, hit = y > 0.5, score >= 0.5
    first = pos[np.lexsort((ids, -score))]
    tp, some = np.cumsum(first), int(pos.sum())
    auc = float(tp[~first].sum() / (some * (n - some))) if 0 < some < n else 0.5
    ap = ratio((tp[first] / (np.flatnonzero(first) + 1)).sum(), some)
    return {"accuracy": ratio((pos == hit).sum(), n), "f1": ratio(2 * (pos & hit).sum(), pos.sum() + hit.sum()), "auc": auc, "average_precision": ap}


class Adam:
    def __init__(self, lr: float = 3e-4, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        self.m: Params = {}
        self.v: Params = {}

    def step(self, p: Params, grads: Params) -> None:
        """Bias-corrected update, in place."""
        self.t += 1
        for k, g in grads.items():
            g = g.full(p[k].shape) if isinstance(g, Rowwise) else g
            self.m[k] = self.b1 * self.m.get(k, 0.0) + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v.get(k, 0.0) + (1 - self.b2) * g * g
            m, v = self.m[k] / (1 - self.b1**self.t), self.v[k] / (1 - self.b2**self.t)
            p[k] = p[k] - self.lr * m / (np.sqrt(v) + self.eps)
