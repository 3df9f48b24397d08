"""Activations, softmax and multilayer perceptrons, as expressions and as a vectorised function."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of the [7/6] Pade approximant of tanh and of GELU in its tanh form.
#: From here on the rational tanh counts as saturated.
SATURATED = 4.97
ROOT_2_PI, CUBIC = 0.7978845608028654, 0.044715


def pade_tanh(x: Column) -> Column:
    """tanh by its [7/6] Pade approximant; +-1 beyond SATURATED."""
    s = x * x
    top = x * (F.lit(135135.0) + s * (F.lit(17325.0) + s * (F.lit(378.0) + s)))
    bottom = F.lit(135135.0) + s * (F.lit(62370.0) + s * (F.lit(3150.0) + s * F.lit(28.0)))
    return F.when(F.abs(x) >= SATURATED, F.signum(x)).otherwise(top / bottom)


def gelu(x: Column) -> Column:
    """GELU in its tanh form, over the rational tanh."""
    return F.lit(0.5) * x * (F.lit(1.0) + pade_tanh(F.lit(ROOT_2_PI) * (x + F.lit(CUBIC) * x * x * x)))


def softmax(logits: Column) -> Column:
    """Softmax of an array of doubles, shifted by its largest element."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(F.array(raised), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of every element."""
    return np.vectorize(math.erf, otypes=[float])(x)


#: Rows of a network's layers at once, so that they stay in a processor's cache.
ROWS = 512


def _gelu(x: np.ndarray) -> np.ndarray:
    """GELU in its tanh form, over the rational tanh, with few arrays in between."""
    z = x * x
    z *= x
    z *= CUBIC
    z += x
    z *= ROOT_2_PI
    s = z * z
    top, bottom = s + 378, s * 28
    bottom += 3150
    for part, n in ((top, 17325), (bottom, 62370), (top, 135135), (bottom, 135135)):
        part *= s
        part += n
    top *= z
    top /= bottom
    far = np.abs(z, out=bottom) >= SATURATED
    np.copyto(top, np.sign(z, out=z), where=far)
    top += 1
    top *= x
    top *= 0.5
    return top


@dataclass
class Mlp:
    """Layers of weights (out x in) and biases; GELU between, softmax at the end, or a sigmoid where there is one output.

    exact: GELU by the error function instead of its tanh form.
    """

    layers: list[tuple[np.ndarray, np.ndarray]]
    exact: bool = False

    @classmethod
    def literal(cls, sizes: tuple[int, ...]) -> Mlp:
        """Weights ((7i + 3j + 5l) mod 11 - 5) / 10 of row i, column j in layer l; biases ((3i + l) mod 5 - 2) / 10."""
        made = []
        for n, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            i, j = np.indices((b, a))
            made.append((((7 * i + 3 * j + 5 * n) % 11 - 5) / 10, ((3 * np.arange(b) + n) % 5 - 2) / 10))
        return cls(made)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each row."""
        if not len(x):
            return self._block(x)
        return np.concatenate([self._block(x[i : i + ROWS]) for i in range(0, len(x), ROWS)])

    def _block(self, x: np.ndarray) -> np.ndarray:
        for n, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if n < len(self.layers) - 1 and self.exact:
                x = 0.5 * x * (1 + erf(x / 2**0.5))
            elif n < len(self.layers) - 1:
                x = _gelu(x)
        if x.shape[1] == 1:
            return 1 / (1 + np.exp(-x))
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def udf(self):
        """A vectorised function from arrays to arrays of probabilities."""
        layers, exact = self.layers, self.exact

        @F.arrow_udf("array<double>")
        def infer(vec: pa.Array) -> pa.Array:
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), len(layers[0][0][0]))
            p = Mlp(layers, exact).forward(x)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))

        return infer

    def flat(self) -> list[float]:
        """All weights and biases, layer by layer, rows first."""
        return [float(v) for w, b in self.layers for part in (w, b) for v in np.ravel(part)]

    @classmethod
    def unflat(cls, values: list[float], sizes: tuple[int, ...]) -> Mlp:
        need = sum(b * a + b for a, b in zip(sizes, sizes[1:], strict=False))
        if len(values) != need:
            raise ValueError(f"{len(values)} weights, but these sizes need {need}")
        made, at, v = [], 0, np.asarray(values, float)
        for a, b in zip(sizes, sizes[1:], strict=False):
            made.append((v[at : at + a * b].reshape(b, a), v[at + a * b : at + a * b + b]))
            at += a * b + b
        return cls(made)


#: Layers of the binary network, and the weight of denied rows in its loss.
BINARY, POS_WEIGHT = (14, 64, 64, 64, 1), 3.0


def train_binary(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = BINARY[1:-1], epochs: int = 12, rate: float = 1e-3, batch: int = 512, seed: int = 42, pos_weight: float = POS_WEIGHT) -> Mlp:
    """Binary cross entropy of logits by Adam, label 1 weighted by pos_weight, on a bounded sample; keeps the epoch of the least loss on every tenth row.

    The network has one output and GELU by the error function.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = (x.shape[1], *hidden, 1)
    p = [v for a, b in zip(sizes, sizes[1:], strict=False) for v in (rng.uniform(-(a**-0.5), a**-0.5, (b, a)), np.zeros(b))]
    held = np.arange(len(x)) % 10 == 9
    tx, ty = x[~held], y[~held]
    hx, hy = (x[held], y[held]) if held.any() else (tx, ty)
    m, v, best, kept, step = [np.zeros_like(t) for t in p], [np.zeros_like(t) for t in p], np.inf, [t.copy() for t in p], 0

    def logits(rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hs, zs = [rows], []
        for k in range(0, len(p), 2):
            zs.append(hs[-1] @ p[k].T + p[k + 1])
            hs.append(0.5 * zs[-1] * (1 + erf(zs[-1] / 2**0.5)) if k < len(p) - 2 else zs[-1])
        return hs, zs

    def loss(z: np.ndarray, label: np.ndarray) -> float:
        soft = lambda a: np.logaddexp(0, a)
        return float(np.mean(np.where(label == 1, pos_weight * soft(-z), soft(z))))

    for _ in range(epochs):
        order = rng.permutation(len(tx))
        for i in range(0, len(order), batch):
            xb, yb = tx[order[i : i + batch]], ty[order[i : i + batch]]
            hs, zs = logits(xb)
            q = 1 / (1 + np.exp(-zs[-1][:, 0]))
            d = (np.where(yb == 1, pos_weight * (q - 1), q) / len(yb))[:, None]
            step += 1
            for k in range(len(p) - 2, -1, -2):
                grads = (d.T @ hs[k // 2], d.sum(axis=0))
                if k:
                    z = zs[k // 2 - 1]
                    d = (d @ p[k]) * (0.5 * (1 + erf(z / 2**0.5)) + z * np.exp(-z * z / 2) / (2 * math.pi) ** 0.5)
                for j, g in enumerate(grads):
                    m[k + j] = 0.9 * m[k + j] + 0.1 * g
                    v[k + j] = 0.999 * v[k + j] + 0.001 * g * g
                    p[k + j] = p[k + j] - rate * (m[k + j] / (1 - 0.9**step)) / (np.sqrt(v[k + j] / (1 - 0.999**step)) + 1e-8)
        now = loss(logits(hx)[1][-1][:, 0], hy)
        if now < best:
            best, kept = now, [t.copy() for t in p]
    return Mlp([(kept[k], kept[k + 1]) for k in range(0, len(kept), 2)], exact=True)


def train_mlp(x: np.ndarray, y: np.ndarray, sizes: tuple[int, ...], epochs: int = 40, rate: float = 3e-3, batch: int = 512, seed: int = 42, patience: int = 8, guarded: int | None = None) -> Mlp:
    """Class-weighted cross entropy by Adam, on a bounded sample; keeps the best epoch and stops early.

    Weights of classes are inverse to their frequency, 1 at least. With a guarded
    class the kept epoch is that which sends the fewest of its rows, of all that
    are given, elsewhere (of equals the latest), and none of them ends the training.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    p = [v for a, b in zip(sizes, sizes[1:], strict=False) for v in (rng.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b))]
    counts = np.bincount(y, minlength=sizes[-1])
    weight = np.maximum(counts.sum() / (np.maximum(counts, 1) * sizes[-1]), 1.0)
    m, v, best, kept, waited, step = [np.zeros_like(t) for t in p], [np.zeros_like(t) for t in p], np.inf, None, 0, 0
    fewest, guard = len(x) + 1, None
    held = np.arange(len(x)) % 10 == 0
    tx, ty, hx, hy = x[~held], y[~held], x[held], y[held]
    for _ in range(epochs):
        order = rng.permutation(len(tx))
        for i in range(0, len(order), batch):
            xb, yb = tx[order[i : i + batch]], ty[order[i : i + batch]]
            hs, zs = [xb], []
            for k in range(0, len(p), 2):
                zs.append(hs[-1] @ p[k].T + p[k + 1])
                hs.append(0.5 * zs[-1] * (1 + np.tanh(ROOT_2_PI * (zs[-1] + CUBIC * zs[-1] ** 3))) if k < len(p) - 2 else zs[-1])
            e = np.exp(hs[-1] - hs[-1].max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - np.eye(sizes[-1])[yb]) * weight[yb][:, None] / weight[yb].sum()
            grads = [None] * len(p)
            for k in range(len(p) - 2, -1, -2):
                grads[k], grads[k + 1] = d.T @ hs[k // 2], d.sum(axis=0)
                if k:
                    z = zs[k // 2 - 1]
                    t = np.tanh(ROOT_2_PI * (z + CUBIC * z**3))
                    d = (d @ p[k]) * (0.5 * (1 + t) + 0.5 * z * (1 - t * t) * ROOT_2_PI * (1 + 3 * CUBIC * z * z))
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = Mlp([(p[k], p[k + 1]) for k in range(0, len(p), 2)])
        prob = net.forward(hx if len(hx) else tx)
        loss = float(-np.log(prob[np.arange(len(prob)), hy if len(hx) else ty] + 1e-12).mean())
        if guarded is not None:
            away = int((net.forward(x[y == guarded]).argmax(axis=1) != guarded).sum()) if (y == guarded).any() else 0
            if away <= fewest:
                fewest, guard = away, Mlp([(w.copy(), b.copy()) for w, b in net.layers])
            if not away:
                break
        if loss < best - 1e-4:
            best, kept, waited = loss, Mlp([(w.copy(), b.copy()) for w, b in net.layers]), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept if guarded is None else guard
