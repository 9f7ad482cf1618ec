"""Fusion heads: what one task computes on its rows.

A head is a set of hidden branches (dense, relu, dropout, batch normalization) and a top.
The functions here return plain sums over rows, so that partitions only have to be added.
Batch normalization spans the whole batch although its rows sit in many tasks: a first
pass adds up the branch moments, and the second pass returns three products per branch
from which the exact gradient follows once the sums over all tasks are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

METHODS = ("image_only", "text_only", "linear", "mlp_early", "mlp_late", "gated_attention", "mcr_late", "i2moe")

# Fixed values of the losses.
AUX_WEIGHT = 0.01
MARGIN = 1.0
BN_EPS, BN_MOMENTUM, DISTANCE_EPS, COSINE_EPS = 1e-5, 0.1, 1e-6, 1e-8


@dataclass(frozen=True)
class Branch:
    """One use of a hidden branch: ``params`` may be shared by several uses."""

    name: str
    params: str
    source: str  # text, image, both or none (a missing modality)


@dataclass(frozen=True)
class Spec:
    method: str
    text_dim: int
    image_dim: int
    outputs: int
    hidden: int = 128
    dropout: float = 0.2
    loss: str = "ce"  # or "bce"

    def branches(self) -> list[Branch]:
        m = self.method
        if m == "mlp_early":
            return [Branch("features", "features", "both")]
        if m in ("mlp_late", "gated_attention", "mcr_late"):
            return [Branch("text", "text_fc", "text"), Branch("image", "image_fc", "image")]
        if m == "i2moe":
            out = []
            for case, text, image in (("full", "text", "image"), ("no_text", "none", "image"), ("no_image", "text", "none")):
                for e in range(4):
                    out.append(Branch(f"{case}.{e}.text", f"expert{e}.text_fc", text))
                    out.append(Branch(f"{case}.{e}.image", f"expert{e}.image_fc", image))
            return out
        return []

    def shapes(self) -> dict[str, tuple[int, ...]]:
        t, i, h, c = self.text_dim, self.image_dim, self.hidden, self.outputs
        dense: dict[str, tuple[int, int]] = {}
        normed: list[str] = []
        m = self.method
        if m in ("image_only", "text_only"):
            dense["classifier"] = (c, i if m == "image_only" else t)
        elif m == "linear":
            dense["classifier"] = (c, t + i)
        elif m == "mlp_early":
            dense.update({"features": (h, t + i), "classifier": (c, h)})
            normed = ["features"]
        elif m in ("mlp_late", "gated_attention", "mcr_late"):
            dense.update({"text_fc": (h, t), "image_fc": (h, i)})
            normed = ["text_fc", "image_fc"]
            if m == "gated_attention":
                dense.update({"gate0": (h, 2 * h), "gate1": (2, h), "classifier": (c, h)})
            else:
                dense["classifier"] = (c, 2 * h)
            if m == "mcr_late":
                dense.update({"text_classifier": (c, h), "image_classifier": (c, h)})
        elif m == "i2moe":
            for e in range(4):
                dense.update({f"expert{e}.text_fc": (h, t), f"expert{e}.image_fc": (h, i), f"expert{e}.classifier": (c, 2 * h)})
                normed += [f"expert{e}.text_fc", f"expert{e}.image_fc"]
            dense.update({"reweight0": (h, t + i), "reweight1": (4, h)})
        else:
            raise ValueError(f"method must be one of {METHODS}")
        shapes: dict[str, tuple[int, ...]] = {}
        for name, (rows, cols) in dense.items():
            shapes[f"{name}.weight"], shapes[f"{name}.bias"] = (rows, cols), (rows,)
        for name in normed:
            shapes[f"{name}.gamma"], shapes[f"{name}.beta"] = (h,), (h,)
        return shapes

    def start(self, seed: int) -> tuple[dict, dict]:
        """Initial parameters (uniform within 1/sqrt(inputs)) and running moments."""
        rng = np.random.default_rng(seed)
        params, running = {}, {}
        for name, shape in self.shapes().items():
            if name.endswith(".weight"):
                bound = shape[1] ** -0.5
                params[name] = rng.uniform(-bound, bound, shape)
                params[name[:-6] + "bias"] = rng.uniform(-bound, bound, shape[0])
            elif name.endswith(".gamma"):
                params[name], params[name[:-5] + "beta"] = np.ones(shape), np.zeros(shape)
                running[name[:-6]] = (np.zeros(shape), np.ones(shape))
        return params, running


def keep_mask(rows: np.ndarray, units: int, seed: int, step: int, stream: int, p: float) -> np.ndarray:
    """Dropout factors from a hash of (seed, step, stream, row, unit): partitioning cannot change them."""
    if p == 0:
        return np.ones((len(rows), units))
    with np.errstate(over="ignore"):
        salt = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 1009 + stream) * np.uint64(0xD1B54A32D192ED03)
        x = rows.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.arange(units, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + salt
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)) * 2.0**-53 >= p) / (1 - p)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def nll(p, y):
    return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))


class Pass:
    """One head on the rows of one task, with the parameters of one step."""

    def __init__(self, spec: Spec, params: dict, data: dict, moments: dict | None = None, drop=None, scoring: bool = False):
        self.spec, self.p, self.data, self.moments, self.drop = spec, params, data, moments, drop
        self.uses = [b for b in spec.branches() if not (scoring and b.name.startswith("no_"))]
        self.cases = ("full",) if scoring else ("full", "no_text", "no_image")
        self.n = len(data["text"])
        self.grads: dict[str, np.ndarray] = {}
        self.saved: dict[str, tuple] = {}

    def source(self, name: str):
        t, i = self.data["text"], self.data["image"]
        if name == "both":
            return np.hstack([t, i])
        return {"text": t, "image": i, "none": None}[name]

    def hidden(self, k: int, b: Branch):
        """Inputs, factor of relu and dropout, and activations of one branch."""
        x, bias = self.source(b.source), self.p[f"{b.params}.bias"]
        z = np.tile(bias, (self.n, 1)) if x is None else x @ self.p[f"{b.params}.weight"].T + bias
        m = (z > 0) * (1.0 if self.drop is None else keep_mask(self.data["row"], self.spec.hidden, *self.drop, k, self.spec.dropout))
        return x, m, z * m

    def branch_moments(self) -> dict[str, np.ndarray]:
        out = {}
        for k, b in enumerate(self.uses):
            _, _, a = self.hidden(k, b)
            out[f"{b.name}.sum"], out[f"{b.name}.square"] = a.sum(0), (a * a).sum(0)
        return out

    def outputs(self) -> dict[str, np.ndarray]:
        """Normalized branch outputs."""
        h = {}
        for k, b in enumerate(self.uses):
            x, m, a = self.hidden(k, b)
            mean, var = self.moments[b.name]
            hat = (a - mean) / np.sqrt(var + BN_EPS)
            self.saved[b.name] = (x, m, hat)
            h[b.name] = self.p[f"{b.params}.gamma"] * hat + self.p[f"{b.params}.beta"]
        return h

    def dense(self, name: str, x):
        return x @ self.p[f"{name}.weight"].T + self.p[f"{name}.bias"]

    def dense_back(self, name: str, x, dy):
        for key, g in ((f"{name}.weight", dy.T @ x), (f"{name}.bias", dy.sum(0))):
            self.grads[key] = self.grads.get(key, 0) + g
        return dy @ self.p[f"{name}.weight"]

    def branch_back(self, dh: dict[str, np.ndarray]) -> None:
        """Sums from which ``finish_branches`` makes the gradient of the whole batch."""
        for b in self.uses:
            x, m, hat = self.saved[b.name]
            d = dh[b.name]
            x1 = np.ones((self.n, 1)) if x is None else np.hstack([x, np.ones((self.n, 1))])
            self.grads[f"{b.name}.dbeta"], self.grads[f"{b.name}.dgamma"] = d.sum(0), (d * hat).sum(0)
            for key, f in (("g1", d * m), ("g2", m), ("g3", hat * m)):
                self.grads[f"{b.name}.{key}"] = f.T @ x1

    # Tops: logits, and from the scaled loss gradients back to the branches

    def logits(self):
        """Class logits, plus what the method's loss and export need."""
        m, h = self.spec.method, self.outputs()
        if m in ("image_only", "text_only", "linear"):
            x = self.source({"image_only": "image", "text_only": "text", "linear": "both"}[m])
            return self.dense("classifier", x), {"x": x}
        if m == "mlp_early":
            return self.dense("classifier", h["features"]), {"h": h}
        if m in ("mlp_late", "mcr_late"):
            x = np.hstack([h["text"], h["image"]])
            extra = {"h": h, "x": x}
            if m == "mcr_late":
                extra["text"], extra["image"] = self.dense("text_classifier", h["text"]), self.dense("image_classifier", h["image"])
            return self.dense("classifier", x), extra
        if m == "gated_attention":
            x = np.hstack([h["text"], h["image"]])
            u = np.maximum(self.dense("gate0", x), 0)
            g = softmax(self.dense("gate1", u))
            mixed = g[:, :1] * h["text"] + g[:, 1:] * h["image"]
            return self.dense("classifier", mixed), {"h": h, "x": x, "u": u, "gates": g, "mixed": mixed}
        x = self.source("both")
        u = np.maximum(self.dense("reweight0", x), 0)
        w = softmax(self.dense("reweight1", u))
        cases = {}
        for case in self.cases:
            joined = [np.hstack([h[f"{case}.{e}.text"], h[f"{case}.{e}.image"]]) for e in range(4)]
            cases[case] = (joined, [self.dense(f"expert{e}.classifier", joined[e]) for e in range(4)])
        z = sum(w[:, e : e + 1] * cases["full"][1][e] for e in range(4))
        return z, {"x": x, "u": u, "w": w, "cases": cases}

    def loss_and_grads(self, batch_n: float, batch_weight: float, weights: np.ndarray) -> float:
        """Adds this task's share of the batch loss to ``grads``; returns the share."""
        s, y = self.spec, self.data["y"]
        z, extra = self.logits()
        if s.loss == "bce":
            # mean over rows and labels; ``weights`` is (label weight, positive weight)
            w, pos = weights
            sig = 1 / (1 + np.exp(-z))
            scale = 1.0 / (batch_n * s.outputs)
            up = 1 + (pos - 1) * y
            loss = float((w * scale * ((1 - y) * z + up * np.logaddexp(0, -z))).sum())
            dz = w * scale * ((1 - y) - up * (1 - sig))
            dz_aux = None
        else:
            y = y[:, 0].astype(int)
            p = softmax(z)
            per, share = nll(p, y), weights[y] / batch_weight
            loss, coef, dz_aux = float((per * share).sum()), share, None
            if s.method == "mcr_late":
                loss, coef, dz_aux = self.mcr(extra, y, per, share, batch_n, loss)
            dz = p.copy()
            dz[np.arange(len(y)), y] -= 1
            dz *= coef[:, None]
            if s.method == "i2moe":
                aux, dz_aux = self.interaction(extra["cases"], batch_n)
                loss += aux
        self.back(dz, extra, dz_aux)
        return loss

    def mcr(self, extra, y, per, share, n, loss):
        """Unimodal terms and the hinge of the fused loss over the better modality."""
        pt, pi = softmax(extra["text"]), softmax(extra["image"])
        lt, li = nll(pt, y), nll(pi, y)
        worse = (per > np.minimum(lt, li)) / n
        text_best = np.where(lt < li, 1.0, np.where(lt == li, 0.5, 0.0))
        loss += float((AUX_WEIGHT * share * (lt + li) + worse * (per - np.minimum(lt, li))).sum())
        aux = {}
        for name, p, best in (("text", pt, text_best), ("image", pi, 1 - text_best)):
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            aux[name] = d * (AUX_WEIGHT * share - worse * best)[:, None]
        return loss, share + worse, aux

    def interaction(self, cases, n):
        """Triplets of the uniqueness experts, cosines of the synergy and redundancy experts."""
        full, no_text, no_image = (cases[c][1] for c in ("full", "no_text", "no_image"))
        d = {c: [np.zeros_like(v) for v in cases[c][1]] for c in cases}
        loss, scale = 0.0, AUX_WEIGHT / n
        for e, near, far in ((0, "no_image", "no_text"), (1, "no_text", "no_image")):
            a = full[e] - cases[near][1][e] + DISTANCE_EPS
            b = full[e] - cases[far][1][e] + DISTANCE_EPS
            da, db = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
            on = (da - db + MARGIN > 0) * scale
            loss += float((on * (da - db + MARGIN)).sum())
            ga, gb = on * a / np.maximum(da, 1e-300), on * b / np.maximum(db, 1e-300)
            d["full"][e] += ga - gb
            d[near][e] -= ga
            d[far][e] += gb
        for e, sign in ((2, 0.5), (3, -0.5)):
            for case, other in (("no_text", no_text), ("no_image", no_image)):
                x, v = full[e], other[e]
                nx = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), COSINE_EPS)
                nv = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), COSINE_EPS)
                cos = (x * v).sum(1, keepdims=True) / (nx * nv)
                loss += float(scale * sign * cos.sum() + (scale * 0.5 * len(x) if e == 3 else 0.0))
                d["full"][e] += scale * sign * (v / (nx * nv) - cos * x / nx**2)
                d[case][e] += scale * sign * (x / (nx * nv) - cos * v / nv**2)
        return loss, d

    def back(self, dz, extra, aux) -> None:
        m, h = self.spec.method, self.spec.hidden
        dh: dict[str, np.ndarray] = {}
        if m in ("image_only", "text_only", "linear"):
            self.dense_back("classifier", extra["x"], dz)
        elif m == "mlp_early":
            dh["features"] = self.dense_back("classifier", extra["h"]["features"], dz)
        elif m in ("mlp_late", "mcr_late"):
            dx = self.dense_back("classifier", extra["x"], dz)
            dh["text"], dh["image"] = dx[:, :h], dx[:, h:]
            for name in ("text", "image") if m == "mcr_late" else ():
                dh[name] = dh[name] + self.dense_back(f"{name}_classifier", extra["h"][name], aux[name])
        elif m == "gated_attention":
            g, b = extra["gates"], extra["h"]
            dmix = self.dense_back("classifier", extra["mixed"], dz)
            dg = np.column_stack([(dmix * b["text"]).sum(1), (dmix * b["image"]).sum(1)])
            du = self.dense_back("gate1", extra["u"], g * (dg - (dg * g).sum(1, keepdims=True)))
            dx = self.dense_back("gate0", extra["x"], du * (extra["u"] > 0))
            dh["text"], dh["image"] = dx[:, :h] + g[:, :1] * dmix, dx[:, h:] + g[:, 1:] * dmix
        else:
            w, cases = extra["w"], extra["cases"]
            dw = np.column_stack([(dz * cases["full"][1][e]).sum(1) for e in range(4)])
            du = self.dense_back("reweight1", extra["u"], w * (dw - (dw * w).sum(1, keepdims=True)))
            self.dense_back("reweight0", extra["x"], du * (extra["u"] > 0))
            for case in cases:
                for e in range(4):
                    d = aux[case][e] + (w[:, e : e + 1] * dz if case == "full" else 0)
                    dx = self.dense_back(f"expert{e}.classifier", cases[case][0][e], d)
                    dh[f"{case}.{e}.text"], dh[f"{case}.{e}.image"] = dx[:, :h], dx[:, h:]
        if dh:
            self.branch_back(dh)


def finish_branches(spec: Spec, params: dict, sums: dict, moments: dict, n: float) -> dict[str, np.ndarray]:
    """Gradients of all parameters from the sums over the whole batch."""
    grads = {k: v for k, v in sums.items() if k in params}
    for b in spec.branches():
        gamma, (_, var) = params[f"{b.params}.gamma"], moments[b.name]
        dbeta, dgamma = sums[f"{b.name}.dbeta"], sums[f"{b.name}.dgamma"]
        g = sums[f"{b.name}.g1"] - (dbeta / n)[:, None] * sums[f"{b.name}.g2"] - (dgamma / n)[:, None] * sums[f"{b.name}.g3"]
        g = (gamma / np.sqrt(var + BN_EPS))[:, None] * g
        parts = {f"{b.params}.bias": g[:, -1], f"{b.params}.gamma": dgamma, f"{b.params}.beta": dbeta}
        if b.source != "none":
            parts[f"{b.params}.weight"] = g[:, :-1]
        for key, v in parts.items():
            grads[key] = grads.get(key, 0) + v
    return grads


def batch_moments(spec: Spec, sums: dict, n: float) -> dict[str, tuple]:
    out = {}
    for b in spec.branches():
        mean = sums[f"{b.name}.sum"] / n
        out[b.name] = (mean, np.maximum(sums[f"{b.name}.square"] / n - mean * mean, 0.0))
    return out


def update_running(spec: Spec, running: dict, moments: dict, n: float) -> None:
    """Exponential averages for scoring, in the order of the branch uses; variance unbiased."""
    for b in spec.branches():
        mean, var = running[b.params]
        m, v = moments[b.name]
        v = v * n / max(n - 1, 1)
        running[b.params] = (mean + BN_MOMENTUM * (m - mean), var + BN_MOMENTUM * (v - var))


def scoring_moments(spec: Spec, running: dict) -> dict[str, tuple]:
    return {b.name: running[b.params] for b in spec.branches()}
