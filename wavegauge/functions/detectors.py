"""Sequential change detectors: small state, one value at a time.

ADWIN follows Bifet and Gavalda (2007), KSWIN Raab et al. (2020), Page-Hinkley Page (1954), DDM
Gama et al. (2004) and EDDM Baena-Garcia et al. (2006). Every detector has ``update(x) -> bool``,
restarts itself after a change and pickles to plain attributes.
"""

from __future__ import annotations

import math

import numpy as np


class Adwin:
    """Adaptive window: exponential buckets, a cut where two sub-window means differ too much."""

    def __init__(self, delta: float = 0.01, per_level: int = 5, clock: int = 32, min_window: int = 10, min_side: int = 5):
        self.delta, self.per_level, self.clock = delta, per_level, clock
        self.min_window, self.min_side = min_window, min_side
        self.levels: list[list[tuple[float, float]]] = [[]]  # oldest first per level: (sum, squared deviation)
        self.n, self.total, self.dev, self.seen = 0, 0.0, 0.0, 0

    def update(self, x: float) -> bool:
        self.seen += 1
        if self.n:
            mean = self.total / self.n
            self.dev += self.n * (x - mean) ** 2 / (self.n + 1)
        self.n += 1
        self.total += x
        self.levels[0].append((x, 0.0))
        self._compress()
        if self.seen % self.clock or self.n < self.min_window:
            return False
        changed = False
        while self._cut():
            changed = True
        return changed

    def _compress(self) -> None:
        k = 0
        while k < len(self.levels) and len(self.levels[k]) > self.per_level:
            (s1, d1), (s2, d2) = self.levels[k][:2]
            del self.levels[k][:2]
            size = 2**k
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append((s1 + s2, d1 + d2 + (s1 - s2) ** 2 / (2 * size)))
            k += 1

    def _cut(self) -> bool:
        n0, s0 = 0, 0.0
        spread = self.dev / self.n
        log_term = math.log(2 * math.log(max(self.n, 3)) / self.delta)
        for k in range(len(self.levels) - 1, -1, -1):
            for s, _ in self.levels[k]:
                n0 += 2**k
                s0 += s
                n1 = self.n - n0
                if n1 < self.min_side:
                    return False
                if n0 < self.min_side:
                    continue
                m = 1 / (n0 - self.min_side + 1) + 1 / (n1 - self.min_side + 1)
                eps = math.sqrt(2 * m * spread * log_term) + 2 / 3 * m * log_term
                if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                    self._drop_oldest()
                    return True
        return False

    def _drop_oldest(self) -> None:
        k = len(self.levels) - 1
        s, d = self.levels[k].pop(0)
        size = 2**k
        rest = self.n - size
        gap = s / size - (self.total - s) / rest
        self.dev = max(0.0, self.dev - d - size * rest * gap * gap / self.n)
        self.n, self.total = rest, self.total - s
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()


class Kswin:
    """Kolmogorov-Smirnov test of the newest values against a draw from the rest of the window."""

    def __init__(self, alpha: float = 0.005, window: int = 100, recent: int = 30, seed: int = 42):
        self.alpha, self.window, self.recent, self.seed = alpha, window, recent, seed
        self.buf: list[float] = []
        self.tests = 0

    def update(self, x: float) -> bool:
        self.buf.append(x)
        if len(self.buf) > self.window:
            self.buf.pop(0)
        if len(self.buf) < self.window:
            return False
        self.tests += 1
        rng = np.random.default_rng([self.seed, self.tests])
        old = np.sort(rng.choice(self.buf[: -self.recent], self.recent, replace=False))
        new = np.sort(self.buf[-self.recent :])
        both = np.concatenate([old, new])
        d = np.max(np.abs(np.searchsorted(old, both, "right") - np.searchsorted(new, both, "right"))) / self.recent
        if ks_p_value(d, self.recent, self.recent) <= self.alpha and d > 0.1:
            self.buf = self.buf[-self.recent :]
            return True
        return False


class PageHinkley:
    """Cumulative deviation from the running mean, both directions, with forgetting."""

    def __init__(self, min_instances: int = 30, delta: float = 0.005, threshold: float = 50.0, alpha: float = 0.9999):
        self.min_instances, self.delta, self.threshold, self.alpha = min_instances, delta, threshold, alpha
        self._reset()

    def _reset(self) -> None:
        self.n, self.mean = 0, 0.0
        self.up = self.down = self.low = self.high = 0.0

    def update(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        dev = x - self.mean
        self.up = self.alpha * self.up + dev - self.delta
        self.down = self.alpha * self.down + dev + self.delta
        self.low, self.high = min(self.low, self.up), max(self.high, self.down)
        if self.n < self.min_instances:
            return False
        if self.up - self.low > self.threshold or self.high - self.down > self.threshold:
            self._reset()
            return True
        return False


class Reference:
    """Mean and spread of the first values of a stream; later values count as errors when far from them."""

    def __init__(self, size: int, z: float):
        self.size, self.z = size, z
        self.n, self.mean, self.squares = 0, 0.0, 0.0

    def error(self, x: float) -> bool | None:
        """None while the reference is still being gathered."""
        if self.n < self.size:
            self.n += 1
            step = x - self.mean
            self.mean += step / self.n
            self.squares += step * (x - self.mean)
            return None
        spread = math.sqrt(self.squares / self.n)
        return abs(x - self.mean) >= self.z * (spread if spread > 0 else 1.0)


class Ddm:
    """Error rate plus its deviation against the best point seen so far."""

    def __init__(self, warning: float = 2.0, drift: float = 2.5, min_instances: int = 30, z: float = 2.0, warmup: int = 30):
        self.warning, self.drift, self.min_instances = warning, drift, min_instances
        self.reference = Reference(warmup, z)
        self._reset()

    def _reset(self) -> None:
        self.n, self.p = 0, 0.0
        self.best_p = self.best_s = self.best = math.inf

    def update(self, x: float) -> bool:
        b = self.reference.error(x)
        if b is None:
            return False
        self.n += 1
        self.p += (b - self.p) / self.n
        s = math.sqrt(self.p * (1 - self.p) / self.n)
        if self.n <= self.min_instances:
            return False
        if self.p + s <= self.best:
            self.best_p, self.best_s, self.best = self.p, s, self.p + s
        if self.p + s > self.best_p + self.drift * self.best_s:
            self._reset()
            return True
        return False


class Eddm:
    """Distance between errors against its largest value so far."""

    def __init__(self, warning: float = 0.95, drift: float = 0.9, min_errors: int = 30, z: float = 2.0, warmup: int = 30):
        self.warning, self.drift, self.min_errors = warning, drift, min_errors
        self.reference = Reference(warmup, z)
        self._reset()

    def _reset(self) -> None:
        self.n, self.errors, self.last = 0, 0, 0
        self.mean, self.m2, self.best = 0.0, 0.0, 0.0

    def update(self, x: float) -> bool:
        b = self.reference.error(x)
        if b is None:
            return False
        self.n += 1
        if not b:
            return False
        self.errors += 1
        gap = self.n - self.last
        self.last = self.n
        old = self.mean
        self.mean += (gap - old) / self.errors
        self.m2 += (gap - self.mean) * (gap - old)
        level = self.mean + 2 * math.sqrt(self.m2 / self.errors)
        if level > self.best:
            self.best = level
            return False
        if self.errors >= self.min_errors and level / self.best < self.drift:
            self._reset()
            return True
        return False


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov p-value."""
    if not d > 0:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    total = 0.0
    for j in range(1, 101):
        term = 2 * (-1) ** (j - 1) * math.exp(-2 * (j * lam) ** 2)
        total += term
        if abs(term) < 1e-12:
            break
    return min(1.0, max(0.0, total))


# Registry of the sequential detectors and their fixed parameters.
SEQUENTIAL = {"ADWIN": Adwin, "KSWIN": Kswin, "PageHinkley": PageHinkley, "DDM": Ddm, "EDDM": Eddm}


def rbf_gamma(ref: np.ndarray) -> float:
    """Kernel width by the median rule: one over the median squared distance of the different pairs of the reference."""
    i, j = np.triu_indices(len(ref), 1)
    apart = np.square(ref[i] - ref[j])
    apart = apart[apart > 0]
    return float(1 / np.median(apart)) if len(apart) else 1.0


def mmd2(ref: np.ndarray, act: np.ndarray, gamma: float, labels: np.ndarray | None = None) -> np.ndarray:
    """Unbiased squared MMD, floored at 0, for the given split or for every row of ``labels``."""
    x = np.concatenate([ref, act])
    n, m = len(ref), len(act)
    k = np.exp(-gamma * (x[:, None] - x[None, :]) ** 2)
    np.fill_diagonal(k, 0.0)
    if labels is None:
        labels = np.r_[np.ones(n), np.zeros(m)][None, :]
    kl = labels @ k
    xx = np.einsum("ij,ij->i", kl, labels)
    xy = kl.sum(1) - xx
    yy = k.sum() - xx - 2 * xy
    return np.maximum(xx / (n * (n - 1)) + yy / (m * (m - 1)) - 2 * xy / (n * m), 0.0)


def energy(ref: np.ndarray, act: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Energy distance sqrt(2 * integral (U - V)^2) for the given split or every row of ``labels``."""
    x = np.concatenate([ref, act])
    n, m = len(ref), len(act)
    if labels is None:
        labels = np.r_[np.ones(n), np.zeros(m)][None, :]
    order = np.argsort(x, kind="stable")
    lab = labels[:, order]
    gap = np.cumsum(lab, 1) / n - np.cumsum(1 - lab, 1) / m
    return np.sqrt(2 * (gap[:, :-1] ** 2) @ np.diff(x[order]))
