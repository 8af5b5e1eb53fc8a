"""Small networks in numpy: layers with a forward and a backward pass, and a trainer.

Inputs are (n, features) for tables and (n, channels, w, w) for patches. Layers keep what the backward pass needs.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


class Layer:
    train = False
    #: What a pass leaves for the way back; it grows with the batch and is no part of the model.
    passing: tuple[str, ...] = ()

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in self.passing and k not in ("g_w", "g_b")}

    def params(self) -> list[str]:
        return []

    def children(self) -> list[Layer]:
        return []

    def every(self):
        yield self
        for c in self.children():
            yield from c.every()


class Linear(Layer):
    passing = ("x",)

    def __init__(self, rng, n_in: int, n_out: int):
        self.w, self.b = rng.normal(0, np.sqrt(2 / n_in), (n_in, n_out)), np.zeros(n_out)

    def params(self):
        return ["w", "b"]

    def forward(self, x):
        self.x = x
        return x @ self.w + self.b

    def backward(self, g):
        self.g_w, self.g_b = self.x.T @ g, g.sum(0)
        return g @ self.w.T


class Conv(Layer):
    """A square kernel of odd side; `same` pads with zeros, otherwise the map shrinks."""

    passing = ("v",)

    def __init__(self, rng, n_in: int, n_out: int, side: int = 3, same: bool = False):
        self.pad, self.side = side // 2 if same else 0, side
        self.w, self.b = rng.normal(0, np.sqrt(2 / (n_in * side * side)), (n_out, n_in, side, side)), np.zeros(n_out)

    def params(self):
        return ["w", "b"]

    def _views(self, x, pad):
        return sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad))), (self.side, self.side), axis=(2, 3))

    def forward(self, x):
        self.v = self._views(x, self.pad)
        return np.tensordot(self.v, self.w, ([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2) + self.b[:, None, None]

    def backward(self, g):
        self.g_w, self.g_b = np.tensordot(g, self.v, ([0, 2, 3], [0, 2, 3])), g.sum((0, 2, 3))
        back = self.w[:, :, ::-1, ::-1].transpose(1, 0, 2, 3)
        return np.tensordot(self._views(g, self.side - 1 - self.pad), back, ([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2)


class Norm(Layer):
    """Batch normalisation by channel (axis 1)."""

    passing = ("z", "k")

    def __init__(self, n: int):
        self.w, self.b, self.mean, self.var = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)

    def params(self):
        return ["w", "b"]

    def forward(self, x):
        self.axes = (0,) if x.ndim == 2 else (0, 2, 3)
        shape = (1, -1) + (1,) * (x.ndim - 2)
        if not self.train:
            self.k = 1 / np.sqrt(self.var + 1e-5).reshape(shape)
            by = self.k * self.w.reshape(shape)
            return x * by + (self.b.reshape(shape) - self.mean.reshape(shape) * by)
        n = x.size // len(self.w)
        m = np.add.reduce(x, self.axes) / n
        d = x - m.reshape(shape)
        v = np.add.reduce(d * d, self.axes) / n
        self.mean, self.var = 0.9 * self.mean + 0.1 * m, 0.9 * self.var + 0.1 * v
        self.k = 1 / np.sqrt(v + 1e-5).reshape(shape)
        self.z = d * self.k
        return self.z * self.w.reshape(shape) + self.b.reshape(shape)

    def backward(self, g):
        shape = (1, -1) + (1,) * (g.ndim - 2)
        if self.train:
            self.g_w, self.g_b = (g * self.z).sum(self.axes), g.sum(self.axes)
        g = g * self.w.reshape(shape)
        if self.train:
            n = g.size // len(self.w)
            g = g - np.add.reduce(g, self.axes, keepdims=True) / n - self.z * (np.add.reduce(g * self.z, self.axes, keepdims=True) / n)
        return g * self.k


class Silu(Layer):
    passing = ("x", "s")

    def forward(self, x):
        self.x, self.s = x, 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        return x * self.s

    def backward(self, g):
        return g * (self.s + self.x * self.s * (1 - self.s))


class Relu(Layer):
    passing = ("y",)

    def forward(self, x):
        self.y = np.maximum(x, 0)
        return self.y

    def backward(self, g):
        return g * (self.y > 0)


class Dropout(Layer):
    passing = ("m",)

    def __init__(self, rng, p: float):
        self.rng, self.p = rng, p

    def forward(self, x):
        self.m = (self.rng.random(x.shape) >= self.p) / (1 - self.p) if self.train and self.p > 0 else 1.0
        return x * self.m if self.train and self.p > 0 else x

    def backward(self, g):
        return g * self.m


class Flatten(Layer):
    def forward(self, x):
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, g):
        return g.reshape(self.shape)


class Pool(Layer):
    """The mean of each channel's map."""

    def forward(self, x):
        self.shape = x.shape
        return x.mean((2, 3))

    def backward(self, g):
        return np.broadcast_to(g[:, :, None, None] / (self.shape[2] * self.shape[3]), self.shape)


class Chain(Layer):
    def __init__(self, *layers: Layer):
        self.layers = list(layers)

    def children(self):
        return self.layers

    def forward(self, x):
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def backward(self, g):
        for layer in reversed(self.layers):
            g = layer.backward(g)
        return g


class Residual(Layer):
    """A block plus a 1 x 1 shortcut, cut to the block's smaller map."""

    def __init__(self, rng, n_in: int, n_out: int, same: bool):
        self.block = Chain(Conv(rng, n_in, n_out, 3, same), Norm(n_out))
        self.short, self.act, self.cut = Conv(rng, n_in, n_out, 1), Silu(), 0 if same else 1

    def children(self):
        return [self.block, self.short, self.act]

    def forward(self, x):
        c = self.cut
        return self.act.forward(self.block.forward(x) + self.short.forward(x[:, :, c : x.shape[2] - c, c : x.shape[3] - c]))

    def backward(self, g):
        g, c = self.act.backward(g), self.cut
        return self.block.backward(g) + np.pad(self.short.backward(g), ((0, 0), (0, 0), (c, c), (c, c)))


class Squeeze(Layer):
    """Channels weighed by a gate of their means."""

    passing = ("x", "s")

    def __init__(self, rng, n: int, reduction: int = 16):
        hidden = max(4, n // reduction)
        self.pool, self.f = Pool(), Chain(Linear(rng, n, hidden), Silu(), Linear(rng, hidden, n))

    def children(self):
        return [self.pool, self.f]

    def forward(self, x):
        self.x, self.s = x, 1 / (1 + np.exp(-self.f.forward(self.pool.forward(x))))
        return x * self.s[:, :, None, None]

    def backward(self, g):
        gate = (g * self.x).sum((2, 3)) * self.s * (1 - self.s)
        return g * self.s[:, :, None, None] + self.pool.backward(self.f.backward(gate))


class TwoBranches(Layer):
    """A large window and its centre, embedded apart and mixed by a gate: one number a sample, or one a component."""

    passing = ("a", "b", "s")

    def __init__(self, rng, small: Chain, large: Chain, width: int, inner: int, scalar: bool):
        self.small, self.large, self.gate, self.inner = small, large, Linear(rng, 2 * width, 1 if scalar else width), inner

    def children(self):
        return [self.small, self.large, self.gate]

    def forward(self, x):
        c = (x.shape[2] - self.inner) // 2
        self.c, self.shape = c, x.shape
        self.a, self.b = self.small.forward(x[:, :, c : c + self.inner, c : c + self.inner]), self.large.forward(x)
        self.s = 1 / (1 + np.exp(-np.clip(self.gate.forward(np.concatenate([self.a, self.b], 1)), -60, 60)))
        return self.s * self.a + (1 - self.s) * self.b

    def backward(self, g):
        gs = g * (self.a - self.b)
        gs = (gs.sum(1, keepdims=True) if self.s.shape[1] == 1 else gs) * self.s * (1 - self.s)
        both, n = self.gate.backward(gs), self.a.shape[1]
        gx = np.array(self.large.backward(g * (1 - self.s) + both[:, n:]))
        c = self.c
        gx[:, :, c : c + self.inner, c : c + self.inner] += self.small.backward(g * self.s + both[:, :n])
        return gx


def mlp(rng, n_in: int, cfg: dict) -> Chain:
    layers: list[Layer] = []
    for width in cfg.get("hidden", [32]):
        layers += [Linear(rng, n_in, width), Norm(width), Relu(), Dropout(rng, cfg.get("dropout", 0.0))]
        n_in = width
    return Chain(*layers, Linear(rng, n_in, 1))


def branch(rng, channels: int, window: int, cfg: dict) -> Chain:
    same, layers = cfg.get("padding", "valid") == "same" or window < 1 + 2 * len(cfg.get("channels", [8])), []
    for out in cfg.get("channels", [8]):
        layers += [Residual(rng, channels, out, same)] if cfg.get("residual") else [Conv(rng, channels, out, 3, same), Norm(out), Silu()]
        channels, window = out, window if same else window - 2
    if cfg.get("squeeze"):
        layers.append(Squeeze(rng, channels))
    layers += [Dropout(rng, cfg.get("dropout", 0.0)), Pool() if cfg.get("pool") else Flatten()]
    return Chain(*layers, Linear(rng, channels * (1 if cfg.get("pool") else window * window), cfg.get("embedding", 16)))


def cnn(rng, channels: int, windows: list[int], cfg: dict) -> Chain:
    """One branch, or two for a small and a large window around the same centre, and a head."""
    width, windows = cfg.get("embedding", 16), sorted(windows)
    body = branch(rng, channels, windows[-1], cfg)
    if len(windows) == 2:
        body = TwoBranches(rng, branch(rng, channels, windows[0], cfg), body, width, windows[0], cfg.get("gate") == "scalar")
    return Chain(body, Silu(), Linear(rng, width, 16), Silu(), Dropout(rng, cfg.get("dropout", 0.0) / 2), Linear(rng, 16, 1))


def count_params(net: Layer) -> int:
    return sum(getattr(layer, p).size for layer in net.every() for p in layer.params())


def predict(net: Layer, x: np.ndarray, batch: int = 4096) -> np.ndarray:
    for layer in net.every():
        layer.train = False
    return np.concatenate([net.forward(x[i : i + batch])[:, 0] for i in range(0, len(x), batch)]) if len(x) else np.empty(0)


def gradient(net: Layer, x: np.ndarray) -> np.ndarray:
    """Of each prediction by its own inputs."""
    for layer in net.every():
        layer.train = False
    return net.backward(np.ones_like(net.forward(x)))


class Training:
    """A network on its way: Adam on the smooth L1 loss with warm-up, a rate that falls on plateaus, and clipped gradients."""

    def __init__(self, net: Layer, cfg: dict):
        self.net, self.cfg, self.step, self.falls = net, cfg, 0, 0
        self.slots = [(layer, p) for layer in net.every() for p in layer.params()]
        # All weights are one row of numbers that the layers look into, so that a step is a few operations and not a few for each layer.
        arrays = [getattr(a, p) for a, p in self.slots]
        self.ends = np.cumsum([0] + [w.size for w in arrays])
        self.w = np.concatenate([w.ravel() for w in arrays])
        for (a, p), w, i, j in zip(self.slots, arrays, self.ends, self.ends[1:]):
            setattr(a, p, self.w[i:j].reshape(w.shape))
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def _arrays(self) -> list[np.ndarray]:
        return [getattr(a, k) for a in self.net.every() for k in ("w", "b", "mean", "var") if isinstance(vars(a).get(k), np.ndarray) and k not in a.passing] + [self.m, self.v]

    def vector(self) -> np.ndarray:
        """All that training changes, as one row of numbers."""
        return np.concatenate([a.ravel() for a in self._arrays()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for a in self._arrays():
            a[...] = vector[at : at + a.size].reshape(a.shape)
            at += a.size

    def epoch(self, x, y, rng, augment=None) -> None:
        """One pass over the rows, in batches of a random order."""
        cfg, batch, rate = self.cfg, self.cfg.get("batch", 64), self.cfg.get("rate", 3e-3)
        for layer in self.net.every():
            layer.train = True
            if isinstance(layer, Dropout):
                layer.rng = rng
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            if len(rows) < 2:
                continue
            xb = augment(x[rows], rng) if augment else x[rows]
            d = self.net.forward(xb)[:, 0] - y[rows]
            self.net.backward((np.clip(d, -1, 1) / len(rows))[:, None])
            g = np.concatenate([getattr(a, f"g_{p}").ravel() for a, p in self.slots])
            self.step += 1
            lr = rate * min(1.0, self.step / cfg.get("warmup_steps", 20)) * 0.5**self.falls
            squares = g * g
            if squares.sum() > 0.99:
                g = g * min(1.0, 1 / (np.sqrt(sum(float(squares[i:j].sum()) for i, j in zip(self.ends, self.ends[1:]))) + 1e-12))
            self.m[:], self.v[:] = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
            self.w -= lr * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)

    def loss(self, x, y) -> float:
        """The sum of the loss over the rows."""
        e = np.abs(predict(self.net, x) - y)
        return float(np.where(e < 1, 0.5 * e * e, e - 0.5).sum())


class Stopping:
    """The best epoch by validation loss, and when to end: after `patience` epochs without a gain; the rate falls meanwhile."""

    def __init__(self, cfg: dict, vector: np.ndarray):
        self.patience, self.min_delta = cfg.get("patience", 15), cfg.get("min_delta", 5e-4)
        self.best, self.vector, self.since, self.falls, self.history = np.inf, vector, 0, 0, []

    def see(self, loss: float, vector: np.ndarray) -> bool:
        """Whether to end, once an epoch's loss is known."""
        self.history.append({"epoch": len(self.history) + 1, "loss": loss})
        if loss < self.best - self.min_delta:
            self.best, self.vector, self.since = loss, vector, 0
        else:
            self.since += 1
            self.falls += self.since % max(1, self.patience // 3) == 0
        return self.since >= self.patience


def fit(net: Layer, x, y, xv, yv, cfg: dict, rng, augment=None) -> list[dict]:
    """Train until the validation loss no longer falls. The weights of the best epoch are restored. Returns the history of losses."""
    training = Training(net, cfg)
    stop = Stopping(cfg, training.vector())
    for _ in range(cfg.get("epochs", 60)):
        training.falls = stop.falls
        training.epoch(x, y, rng, augment)
        if stop.see(training.loss(xv, yv) / len(xv) if len(xv) else float("nan"), training.vector()):
            break
    training.load(stop.vector)
    return stop.history
