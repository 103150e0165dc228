"""Plain numpy programs of the models, for rows that are all at hand; the library's fits are compared with them."""

import numpy as np


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic_batch(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of k L2 logistic fits by Newton's method at once. x: n x p; y, weight: k x n. The
    intercept isn't penalised; penalty = 1 / C."""
    x1 = np.column_stack([np.ones(len(x)), x])
    k, q = len(y), x1.shape[1]
    beta, ridge = np.zeros((k, q)), penalty * np.eye(q)
    ridge[0, 0] = 1e-9
    for _ in range(rounds):
        p = _p(beta @ x1.T)
        grad = (weight * (y - p)) @ x1 - beta @ ridge
        hess = np.einsum("kn,ni,nj->kij", weight * np.maximum(p * (1 - p), 1e-9), x1, x1, optimize=True) + ridge
        step = np.linalg.solve(hess, grad[..., None])[..., 0]
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return beta


def _lasso_quadratic(hess: np.ndarray, r: np.ndarray, cost: np.ndarray, start: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """Minimises b'Hb / 2 - r'b + cost'|b|: sweeps over coordinates find the signs, one linear solve the values."""
    h, rs, k, b = hess.tolist(), r.tolist(), cost.tolist(), start.tolist()
    q = range(len(b))
    for sweep in range(sweeps):
        most = 0.0
        for j in q:
            row = h[j]
            g = rs[j] - sum(row[i] * b[i] for i in q) + row[j] * b[j]
            new = (g - k[j] if g > k[j] else g + k[j] if g < -k[j] else 0.0) / row[j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-12:
            break
        if sweep % 4 == 3:
            v = np.array(b)
            on, sign, out = v != 0, np.sign(v), np.zeros(len(b))
            out[on] = np.linalg.solve(hess[np.ix_(on, on)], r[on] - cost[on] * sign[on])
            if (np.sign(out) == sign).all() and (np.abs(r - hess @ out)[~on] <= cost[~on] * (1 + 1e-9)).all():
                return out
    return np.array(b)


def lasso_logistic(x: np.ndarray, y: np.ndarray, c: float, penalize_intercept: bool = True, rounds: int = 200, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (intercept first) of an L1 logistic fit by proximal Newton steps; minimises |b| + C * loss."""
    x1 = np.column_stack([np.ones(len(x)), x])
    q = x1.shape[1]
    cost = np.ones(q)
    if not penalize_intercept:
        cost[0] = 0
    value = lambda b: cost @ np.abs(b) + c * (np.logaddexp(0, z := x1 @ b) - y * z).sum()
    b = np.zeros(q) if start is None else start
    now = value(b)
    for _ in range(rounds):
        p = _p(x1 @ b)
        grad = -c * (x1.T @ (y - p))
        hess = c * (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + 1e-10 * np.eye(q)
        new = _lasso_quadratic(hess, hess @ b - grad, cost, b)
        step, t = new - b, 1.0
        slope = grad @ step + cost @ (np.abs(new) - np.abs(b))
        while t > 1e-10 and (then := value(b + t * step)) > now + 1e-4 * t * slope + 1e-12:
            t /= 2
        if t <= 1e-10:
            break
        b, now = b + t * step, then
        if np.abs(t * step).max() < 1e-9:
            break
    return b


def cox_efron(x: np.ndarray, time: np.ndarray, event: np.ndarray, weight: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge Cox model with Efron's ties: maximises the log partial likelihood less n * penalty / 2 * |b|^2."""
    order = np.argsort(-time, kind="stable")
    x, time, event, weight = x[order], time[order], event[order].astype(bool), weight[order]
    n, p = x.shape
    beta = np.zeros(p)
    cuts = np.flatnonzero(np.diff(time, prepend=np.inf))
    for _ in range(rounds):
        r = weight * np.exp(np.clip(x @ beta, -35, 35))
        grad, hess = -n * penalty * beta, n * penalty * np.eye(p)
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            xs, rs = x[a:b], r[a:b]
            s0, s1, s2 = s0 + rs.sum(), s1 + rs @ xs, s2 + (xs * rs[:, None]).T @ xs
            e = event[a:b]
            d = int(e.sum())
            if not d:
                continue
            xe, re, w = xs[e], rs[e], weight[a:b][e]
            d0, d1, d2 = re.sum(), re @ xe, (xe * re[:, None]).T @ xe
            grad = grad + w @ xe
            for j in range(d):
                f = j / d
                m = (s1 - f * d1) / (s0 - f * d0)
                grad = grad - w.mean() * m
                hess = hess + w.mean() * ((s2 - f * d2) / (s0 - f * d0) - np.outer(m, m))
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return beta


def rank_auc(score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """AUC of each row of scores (k x n); NaN with one class."""
    order = np.argsort(score, axis=1, kind="stable")
    s = np.take_along_axis(score, order, 1)
    n = s.shape[1]
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0), 1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = first[:, 1:]
    end = np.minimum.accumulate(np.where(last, np.arange(n), n)[:, ::-1], 1)[:, ::-1]
    rank = np.empty(s.shape)
    np.put_along_axis(rank, order, (start + end) / 2 + 1, 1)
    p, q = int((label == 1).sum()), int((label == 0).sum())
    return (rank[:, label == 1].sum(1) - p * (p + 1) / 2) / (p * q) if p and q else np.full(len(score), np.nan)


def _scaled(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Missing as 0, then less the train mean over its deviation (ddof 0)."""
    x = np.nan_to_num(x.astype(float))
    m, s = x[train].mean(0), x[train].std(0)
    return np.where(s > 1e-8, (x - m) / np.where(s > 1e-8, s, 1), 0.0)
