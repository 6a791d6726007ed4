"""Many linear models fitted side by side: one pass over the rows serves a step of all of them.

Each model runs its own solver on the driver, as a coroutine that asks for the loss and its derivatives at one point:
Newton steps for logistic models of at most ``NEWTON`` parameters (absolute penalties by coordinate descent on the
quadratic model), L-BFGS with orthant steps for all others; least squares need no steps. Both end at the same optimum. All points asked for are evaluated together: a task holds the rows of a batch
once, scales them as the model's fold demands, maps them to the kernel's features and sums the losses and gradients, P + 2
numbers per model (and the P x P second derivatives for Newton steps). What comes back does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import ceil, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.scale import fit_linear
from tabwright.operators.stats import aggregate_once

SMOOTH = 0.05  # corners of the epsilon-insensitive loss, in units of the label's deviation
NEWTON = 64
ROWS_AT_ONCE = 512  # whose mapped features stay close to the processor
PREDICTED = "fit int, _fold int, _y double, _p double, _s double"


@dataclass(frozen=True)
class Line:
    """One model. ``classes`` above 0: logistic; 0: epsilon-insensitive regression, or least squares with ``squares``.

    ``l1`` and ``l2`` are the penalties of the mean loss. ``kernel`` rbf maps to ``dimensions`` random Fourier features, poly
    to a tensor sketch of that width. ``gamma``: 'scale' (1 / (features x variance of all values)) or 'auto' (1 / features).
    """

    classes: int = 0
    C: float = 1.0
    penalty: str = "l2"
    l1_ratio: float = 0.5
    max_iter: int = 100
    balanced: bool = False
    epsilon: float = 0.1
    kernel: str = "linear"
    gamma: str = "scale"
    degree: int = 3
    dimensions: int = 128
    scaler: str = "standard"
    seed: int = 42
    squares: bool = False
    intercept: bool = True  # of least squares


@dataclass
class Job:
    """A model on the rows outside a fold: scaling, class weights, label scale and feature map."""

    line: Line
    fold: int
    centre: np.ndarray
    scale: np.ndarray
    rows: int
    weights: np.ndarray
    mean: float = 0.0
    spread: float = 1.0
    gamma: float = 1.0
    kernel: tuple = field(default_factory=tuple)
    means: np.ndarray | float = 0.0  # of the scaled features

    def outputs(self) -> int:
        return self.line.classes if self.line.classes > 2 else 1

    def features(self, x: np.ndarray) -> np.ndarray:
        """Scaled, mapped features and a column of ones."""
        z = (x - self.centre) / self.scale
        if self.line.scaler == "normalizer":
            z = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
        if self.line.kernel == "rbf":
            z = np.sqrt(2 / self.line.dimensions) * cosine(z @ self.kernel[0] + self.kernel[1])
        elif self.line.kernel == "poly":
            z = sketch_spectrum(z * np.sqrt(self.gamma), *self.kernel, self.line.dimensions)
        return np.column_stack([z, np.ones(len(z))])

    def width(self) -> int:
        return (len(self.centre) if self.line.kernel == "linear" else self.line.dimensions) + 1

    def penalties(self) -> tuple[float, float]:
        line = self.line
        if not line.classes:
            return 0.0, self.spread / (line.C * self.rows)
        mix = {"l2": 0.0, "l1": 1.0, "elasticnet": line.l1_ratio, "none": 0.0}[line.penalty]
        strength = 0.0 if line.penalty == "none" else 1.0 / (line.C * self.rows)
        return strength * mix, strength * (1 - mix)

    def sums(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weight, loss and gradient of rows."""
        if not self.line.classes:
            r = z @ w[:, 0] - (y - self.mean) / self.spread
            over = np.maximum(np.abs(r) - self.line.epsilon / self.spread, 0)
            small = over < SMOOTH
            loss = np.where(small, over ** 2 / (2 * SMOOTH), over - SMOOTH / 2).sum()
            slope = np.sign(r) * np.where(small, over / SMOOTH, 1.0)
            return np.concatenate([[len(y), loss], slope @ z])
        kind = y.astype(int)
        own = self.weights[kind]
        if self.line.classes <= 2:
            m = z @ w[:, 0]
            loss = np.logaddexp(0, m) - m * kind
            return np.concatenate([[own.sum(), (own * loss).sum()], (own * (1 / (1 + np.exp(-np.clip(m, -700, 700))) - kind)) @ z])
        m = z @ w
        m -= m.max(1, keepdims=True)
        log = np.log(np.exp(m).sum(1))
        p = np.exp(m - log[:, None])
        p[np.arange(len(kind)), kind] -= 1
        loss = own * (log - m[np.arange(len(kind)), kind])
        return np.concatenate([[own.sum(), loss.sum()], (z.T @ (p * own[:, None])).ravel()])

    def newton(self) -> bool:
        return bool(self.line.classes) and self.width() * self.outputs() <= NEWTON

    def curvature(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Second derivatives of a logistic loss, summed over rows."""
        own = self.weights[y.astype(int)]
        m = z @ w
        if self.line.classes <= 2:
            p = 1 / (1 + np.exp(-np.clip(m[:, 0], -700, 700)))
            return (z.T @ (z * (own * p * (1 - p))[:, None])).ravel()
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        k, width = p.shape[1], z.shape[1]
        out = np.zeros((width, k, width, k))
        for a in range(k):
            for b in range(k):
                out[:, a, :, b] = z.T @ (z * (own * p[:, a] * ((a == b) - p[:, b]))[:, None])
        return out.ravel()

    def predict(self, z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted class numbers or values, and the lead of the second of two classes."""
        if not self.line.classes:
            found = z @ w[:, 0] * self.spread + self.mean
            return found, np.full(len(found), np.nan)
        if self.line.classes <= 2:
            m = z @ w[:, 0]
            return (m > 0).astype(float), m
        return (z @ w).argmax(1).astype(float), np.full(len(z), np.nan)


def sketch_tables(width: int, degree: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of the inputs, for each factor of the power."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dimensions, (degree, width)), rng.choice((-1.0, 1.0), (degree, width))


def tensor_sketch(z: np.ndarray, buckets: np.ndarray, signs: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows whose dot products estimate (a . b) ** degree without bias (Pham and Pagh 2013): count sketches, convolved."""
    return np.fft.irfft(_sketch_waves(z, buckets, signs, dimensions), dimensions, axis=1)


def _sketch_waves(z: np.ndarray, buckets: np.ndarray, signs: np.ndarray, dimensions: int) -> np.ndarray:
    """Fourier coefficients of the sketch: products of those of the count sketches, which are linear in the inputs."""
    product = None
    for bucket, sign in zip(buckets, signs):
        table = np.zeros((z.shape[1], dimensions))
        table[np.arange(z.shape[1]), bucket] = sign
        part = (z @ np.fft.rfft(table, axis=1).view(np.float64)).view(np.complex128)
        product = part if product is None else product * part
    return product


def sketch_spectrum(z: np.ndarray, buckets: np.ndarray, signs: np.ndarray, dimensions: int) -> np.ndarray:
    """``tensor_sketch`` in an orthonormal basis of waves: the same dot products, without the way back."""
    waves = _sketch_waves(z, buckets, signs, dimensions)
    weight = np.full(2 * waves.shape[1], np.sqrt(2 / dimensions))
    weight[0] = np.sqrt(1 / dimensions)
    last = len(weight) - (dimensions % 2 == 0)  # of an even number, the last wave has no imaginary part
    if last < len(weight):
        weight[-2] = weight[0]
    out = waves.view(np.float64)[:, :last] * weight[:last]
    return np.column_stack([out[:, :1], out[:, 2:]])  # nor has the constant one


SINE = [(-1) ** k * (2 * np.pi) ** (2 * k + 1) / factorial(2 * k + 1) for k in range(11)]  # of a turn's part


def cosine(angle: np.ndarray) -> np.ndarray:
    """Cosines to 1e-14, by a series on a quarter turn: whole-array steps, several times faster than one call per number."""
    part = angle / (2 * np.pi)
    part -= np.rint(part)
    part = 0.25 - np.abs(part)
    square = part * part
    out = np.full_like(square, SINE[-1])
    for c in SINE[-2::-1]:
        out *= square
        out += c
    out *= part
    return out


def descent(size: int, l1: np.ndarray, l2: np.ndarray, steps: int, memory: int = 8,
            tolerance: float = 1e-4) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimises loss + sum(l1 |x|) + sum(l2 x^2) / 2; yields points, is sent the loss and its gradient there."""
    x = np.zeros(size)

    def whole(x: np.ndarray, found: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
        return found[0] + (l1 * np.abs(x)).sum() + 0.5 * (l2 * x * x).sum(), found[1] + l2 * x

    def pseudo(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
        return np.where(x != 0, g + np.sign(x) * l1, at_zero)
    f, g = whole(x, (yield x))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        slope = pseudo(x, g)
        if np.sqrt(slope @ slope) <= tolerance:
            break
        q, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            used.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used)):
            q += s * (a - (y @ q) / (y @ s))
        if l1.any():
            q = np.where(q * slope > 0, q, 0.0)
        side = np.where(x != 0, np.sign(x), -np.sign(slope))
        step = 1.0 if pairs else 1.0 / max(1.0, np.sqrt(slope @ slope))
        for _ in range(30):
            new = x - step * q
            if l1.any():
                new = np.where((new * side > 0) | (l1 == 0), new, 0.0)
            f_new, g_new = whole(new, (yield new))
            if f_new <= f + 1e-4 * slope @ (new - x):
                break
            step /= 2
        else:
            break
        if (g_new - g) @ (new - x) > 1e-14:
            pairs = [*pairs, (new - x, g_new - g)][-memory:]
        done = abs(f - f_new) <= tolerance * 1e-3 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def newton(size: int, l1: np.ndarray, l2: np.ndarray, steps: int,
           tolerance: float = 1e-9) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]:
    """The same minimum by Newton steps with step halving; is sent the second derivatives as well."""
    x = np.zeros(size)

    def whole(x: np.ndarray, loss: float) -> float:
        return loss + (l1 * np.abs(x)).sum() + 0.5 * (l2 * x * x).sum()
    loss, g, h = yield x
    for _ in range(steps):
        h = h + np.diag(l2 + 1e-9)
        slope, goal = g + l2 * x, None
        if not l1.any():
            goal = x - np.linalg.solve(h, slope)
        else:
            goal, rest = x.copy(), slope.copy()  # rest: slope of the quadratic model at the goal
            for _ in range(1_000):
                moved = 0.0
                for i in range(size):
                    pull = h[i, i] * goal[i] - rest[i]
                    new = np.sign(pull) * max(0.0, abs(pull) - l1[i]) / h[i, i]
                    if new != goal[i]:
                        moved = max(moved, abs(new - goal[i]))
                        rest += h[:, i] * (new - goal[i])
                        goal[i] = new
                if moved < 1e-10:
                    break
        step, f = 1.0, whole(x, loss)
        for _ in range(20):
            new = x + step * (goal - x)
            loss_new, g_new, h_new = yield new
            f_new = whole(new, loss_new)
            if f_new <= f:
                break
            step /= 2
        else:
            break
        x, loss, g, h = new, loss_new, g_new, h_new
        if f - f_new <= tolerance * max(1.0, abs(f)):
            break
    return x


def fit_in_memory(line: Line, x: np.ndarray, y: np.ndarray) -> tuple[Job, np.ndarray]:
    """A logistic or support vector model of rows that one task holds, on standardised inputs."""
    spread = x.std(0)
    size = np.bincount(y.astype(int), minlength=line.classes) if line.classes else np.zeros(1)
    weights = len(y) / (np.count_nonzero(size) * np.maximum(size, 1)) if line.balanced else np.ones(len(size))
    job = Job(line, 0, x.mean(0), np.where(spread > 0, spread, 1.0), len(y), weights, float(y.mean()), float(y.std()) or 1.0)
    z = job.features(x)
    l1, l2 = job.penalties()
    free = np.tile(np.append(np.ones(job.width() - 1), 0.0)[:, None], (1, job.outputs())).ravel()
    solver = (newton if job.newton() else descent)(len(free), l1 * free, l2 * free, line.max_iter)
    at = next(solver)
    while True:
        w = at.reshape(z.shape[1], -1)
        s = job.sums(z, y, w)
        more = [job.curvature(z, y, w).reshape(len(at), -1) / s[0]] if job.newton() else []
        try:
            at = solver.send((s[1] / s[0], s[2:] / s[0], *more))
        except StopIteration as end:
            return job, end.value.reshape(z.shape[1], -1)


def jobs_of(split: DataFrame, features: Sequence[str], label: str, lines: Sequence[Line], k: int) -> list[Job]:
    """Every model with every fold left out; all statistics of a fold come from its training rows."""
    found = []
    for f in range(k):
        train = split.where(F.col("_fold") != f)
        scaling = {}
        for s in {x.scaler for x in lines}:
            linear = fit_linear(train, list(features), s) if s not in ("none", "normalizer") else []
            scaling[s] = (np.array([t.centre for t in linear] or [0.0] * len(features)), np.array([t.scale for t in linear] or [1.0] * len(features)))
        y = quoted(label).cast("double")
        s = aggregate_once(train, {"n": F.count("*"), "m": F.avg(y), "d": F.stddev_pop(y),
                                   **{f"x{i}": F.avg(quoted(c).cast("double")) for i, c in enumerate(features)},
                                   **{f"q{i}": F.avg(F.pow(quoted(c).cast("double"), 2)) for i, c in enumerate(features)}})
        classes = max(x.classes for x in lines)
        size = np.zeros(max(1, classes))
        if classes:
            for r in train.groupBy(quoted(label).cast("int").alias("c")).agg(F.count("*").alias("n")).collect():
                size[r["c"]] = r["n"]
        for line in lines:
            centre, scale = scaling[line.scaler]
            weights = size.sum() / (max(1, np.count_nonzero(size)) * np.maximum(size, 1)) if line.balanced else np.ones(len(size))
            if s["n"]:
                means = (np.array([s[f"x{i}"] for i in range(len(features))]) - centre) / scale
                squares = np.array([s[f"q{i}"] - s[f"x{i}"] ** 2 for i in range(len(features))]) / scale ** 2 + means ** 2
                variance = squares.mean() - means.mean() ** 2
            else:
                means, variance = np.zeros(len(features)), 1.0
            gamma = 1.0 / (len(features) * (variance if line.gamma == "scale" and variance > 0 else 1.0))
            job = Job(line, f, centre, scale, s["n"], weights, s["m"] or 0.0, s["d"] or 1.0, gamma,
                      means=means if line.scaler != "normalizer" else np.zeros(len(features)))
            if line.kernel == "rbf":
                rng = np.random.default_rng(line.seed)
                job.kernel = (rng.normal(scale=np.sqrt(2 * gamma), size=(len(features), line.dimensions)), rng.uniform(0, 2 * np.pi, line.dimensions))
            elif line.kernel == "poly":
                job.kernel = sketch_tables(len(features), line.degree, line.dimensions, line.seed)
            elif line.kernel != "linear":
                raise ValueError(f"kernel {line.kernel} is not offered")
            found.append(job)
    return found


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        yield (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False),
               b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _maps(jobs: Sequence[Job]) -> list[list[int]]:
    """Positions of the jobs that share a fold, a scaling and a map, hence their mapped features."""
    alike: dict[tuple, list[int]] = {}
    for i, job in enumerate(jobs):
        line = job.line
        key = (job.fold, line.scaler, line.kernel, *((job.gamma, line.degree, line.dimensions, line.seed) if line.kernel != "linear" else ()))
        alike.setdefault(key, []).append(i)
    return list(alike.values())


def _tube_sums(jobs: Sequence[Job], z: np.ndarray, y: np.ndarray, at: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``Job.sums`` of regressions on the same mapped rows: two matrix products serve them all."""
    r = z @ np.stack(at, 1) - ((y[:, None] - np.array([j.mean for j in jobs])) / np.array([j.spread for j in jobs]))
    over = np.maximum(np.abs(r) - np.array([j.line.epsilon / j.spread for j in jobs]), 0)
    small = over < SMOOTH
    loss = np.where(small, over ** 2 / (2 * SMOOTH), over - SMOOTH / 2).sum(0)
    slopes = (np.sign(r) * np.where(small, over / SMOOTH, 1.0)).T @ z
    return [np.concatenate([[len(y), own], slope]) for own, slope in zip(loss, slopes)]


def fit_lines(table: DataFrame, width: int, jobs: Sequence[Job]) -> list[np.ndarray]:
    """Coefficients (inputs x outputs) of every job; ``table`` has (_fold, _y, _x)."""
    spark = table.sparkSession
    points, asked = [], {}
    for i, job in enumerate(jobs):
        l1, l2 = job.penalties()
        free = np.tile(np.append(np.ones(job.width() - 1), 0.0)[:, None], (1, job.outputs())).ravel()  # the intercept carries none
        points.append((newton if job.newton() else descent)(len(free), l1 * free, l2 * free, job.line.max_iter))
        asked[i] = next(points[i])
    many = table.rdd.getNumPartitions() > 32
    result: list[np.ndarray] = [np.zeros((j.width(), j.outputs())) for j in jobs]
    while asked:
        order = sorted(asked, key=lambda i: jobs[i].fold)
        shared = spark.sparkContext.broadcast(([replace(jobs[i]) for i in order], [asked[i] for i in order]))

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, at = shared.value
            total = [np.zeros(2 + len(a) + len(a) ** 2 * j.newton()) for a, j in zip(at, mine)]
            for fold, y, x in _batches(batches, width):
                for own in _maps(mine):
                    kept = np.flatnonzero(fold != mine[own[0]].fold)
                    for start in range(0, len(kept), ROWS_AT_ONCE):
                        rows = kept[start:start + ROWS_AT_ONCE]
                        z, labels = mine[own[0]].features(x[rows]), y[rows]
                        tubes = [i for i in own if not mine[i].line.classes]
                        if tubes:
                            for i, found in zip(tubes, _tube_sums([mine[i] for i in tubes], z, labels, [at[i] for i in tubes])):
                                total[i] += found
                        for i in own:
                            if mine[i].line.classes:
                                w, size = at[i].reshape(z.shape[1], -1), 2 + len(at[i])
                                total[i][:size] += mine[i].sums(z, labels, w)
                                if mine[i].newton():
                                    total[i][size:] += mine[i].curvature(z, labels, w)
            yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(total)), pa.int32()), "sums": [t.tobytes() for t in total]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[i] = total.get(i, 0) + np.frombuffer(s)
            yield pa.RecordBatch.from_pydict({"fit": pa.array(list(total), pa.int32()), "sums": pa.array([t.tobytes() for t in total.values()], pa.binary())})
        sums = table.mapInArrow(part, "fit int, sums binary")
        if many:
            sums = sums.repartition("fit").mapInArrow(add, "fit int, sums binary")
        total: dict[int, np.ndarray] = {}
        for r in sums.collect():  # models x (parameters + 2) numbers, of at most 32 tasks
            total[r["fit"]] = total.get(r["fit"], 0) + np.frombuffer(r["sums"])
        shared.destroy()
        for position, i in enumerate(order):
            size = len(asked[i])
            s = total.get(position, np.zeros(2 + size + size ** 2))
            s = s / max(s[0], 1e-300)
            found = (s[1], s[2:2 + size], *([s[2 + size:].reshape(size, size)] if jobs[i].newton() else []))
            try:
                asked[i] = points[i].send(found)
            except StopIteration as end:
                result[i] = end.value.reshape(jobs[i].width(), -1)
                del asked[i]
    return result


def solved(sums: np.ndarray, job: Job) -> np.ndarray:
    """Least squares from the summed products of (features less their means, 1, scaled label); the smallest solution of several."""
    ones = len(sums) - 2
    n, total = sums[ones, ones], sums[ones]
    inner = sums - np.outer(total, total) / n
    size = np.sqrt(np.maximum(inner.diagonal()[:ones], 0))
    flat = size <= np.maximum(1e-7 * np.sqrt(sums.diagonal()[:ones]), 1e-12 * np.sqrt(n) * np.abs(job.means))  # constant on these rows
    result = np.zeros(ones + 1)
    if not job.line.intercept:  # the features and the label themselves
        back = np.eye(len(sums))
        back[:ones, ones], back[-1, ones] = job.means, job.mean / job.spread
        inner = back @ sums @ back.T
        size = np.sqrt(inner.diagonal()[:ones])
        flat = (size == 0) | flat & (np.abs(job.means) * job.scale <= 1e-12 * np.abs(job.centre))
    size = np.where(flat, 1.0, size)
    matrix = np.where(flat[:, None] | flat, 0.0, inner[:ones, :ones] / np.outer(size, size))
    slope = np.linalg.lstsq(matrix, np.where(flat, 0.0, inner[:ones, -1] / size), rcond=1e-12)[0] / size
    result[:ones] = slope
    result[ones] = (total[-1] - slope @ total[:ones]) / n - slope @ job.means if job.line.intercept else -job.mean / job.spread
    return result


def fit_squares(table: DataFrame, width: int, jobs: Sequence[Job]) -> list[np.ndarray]:
    """The same for least squares: one pass sums up the products of the features, from which all models follow."""
    shared = table.sparkSession.sparkContext.broadcast([replace(j) for j in jobs])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        groups = [own[0] for own in _maps(mine)]
        total = [np.zeros((width + 2, width + 2)) for _ in groups]
        for fold, y, x in _batches(batches, width):
            for at, i in enumerate(groups):
                kept = fold != mine[i].fold
                z = np.column_stack([mine[i].features(x[kept]), (y[kept] - mine[i].mean) / mine[i].spread])
                z[:, :width] -= mine[i].means
                total[at] += z.T @ z
        yield pa.RecordBatch.from_pydict({"fit": pa.array(groups, pa.int32()), "sums": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(s)
        yield pa.RecordBatch.from_pydict({"fit": pa.array(list(total), pa.int32()), "sums": pa.array([t.tobytes() for t in total.values()], pa.binary())})
    found = table.mapInArrow(part, "fit int, sums binary").repartition("fit").mapInArrow(add, "fit int, sums binary").collect()
    sums = {r["fit"]: np.frombuffer(r["sums"]).reshape(width + 2, width + 2) for r in found}  # a matrix per fold and scaling
    result = [np.zeros((width + 1, 1)) for _ in jobs]
    for own in _maps(jobs):
        for i in own:
            if own[0] in sums and sums[own[0]][-2, -2]:
                result[i] = solved(sums[own[0]], jobs[i])[:, None]
    return result


def out_of_fold(split: DataFrame, features: Sequence[str], label: str, lines: Sequence[Line], k: int) -> DataFrame:
    """(fit, _fold, _y, _p, _s): each fold's rows predicted by the models of the other rows; fit = line x k + fold."""
    jobs = jobs_of(split, features, label, lines, k)
    table = split.select(F.col("_fold").cast("int").alias("_fold"), quoted(label).cast("double").alias("_y"),
                         F.array(*[quoted(f).cast("double") for f in features]).alias("_x"))
    cores = split.sparkSession.sparkContext.defaultParallelism  # each step waits for its last task: as many parts for each core
    table = table.repartition(cores * ceil(table.rdd.getNumPartitions() / cores)).persist()
    width = len(features)
    found = (fit_squares if all(x.squares for x in lines) else fit_lines)(table, width, jobs)
    shared = split.sparkSession.sparkContext.broadcast((jobs, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, coefficients = shared.value
        for fold, y, x in _batches(batches, width):
            for same in _maps(every):
                own = np.flatnonzero(fold == every[same[0]].fold)
                z = every[same[0]].features(x[own])
                for i in same:
                    guess, lead = every[i].predict(z, coefficients[i])
                    fit = i % len(lines) * k + every[i].fold
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), fit, np.int32)), pa.array(np.full(len(own), every[i].fold, np.int32)),
                         pa.array(y[own]), pa.array(guess), pa.array(lead, from_pandas=True)], names=["fit", "_fold", "_y", "_p", "_s"])
    return table.mapInArrow(run, PREDICTED)
