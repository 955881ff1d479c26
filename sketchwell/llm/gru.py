"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Symbols are numbered; symbol s is in class s // MEMBERS. P(s | h) = P(class | h) P(s | class, h).
Texts run in lanes: each lane is a row of texts end to end, and its state is carried from window to
window and zeroed where a text starts.
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASSES, MEMBERS = 16, 16, 32
SYMBOLS = CLASSES * MEMBERS
SHAPES = {"emb": (SYMBOLS, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "vc": (HIDDEN, CLASSES), "bc": (CLASSES,), "vw": (SYMBOLS, HIDDEN), "bw": (SYMBOLS,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Windows that training is dealt over, symbols of a window at least and at most, and its steps at least and at most.
WINDOWS, LEAST_SYMBOLS, MOST_SYMBOLS, LEAST_STEPS, MOST_STEPS = 256, 1024, 8192, 16, 256
#: Lanes at most and at least, and symbols for each lane in between.
LANES, LEAST_LANES, LANE_SYMBOLS = 512, 16, 2048


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(counts: np.ndarray) -> np.ndarray:
    """Parameters whose output is the symbols' shares, whatever the state."""
    flat = (0.1 * np.random.default_rng(5).standard_normal(SIZE)).astype("float32")
    p, c = views(flat), (counts + 0.5).reshape(CLASSES, MEMBERS)
    p["b"][:] = 0
    p["vc"][:] *= 0.1
    p["vw"][:] *= 0.1
    p["bc"][:] = np.log(c.sum(axis=1) / c.sum())
    p["bw"][:] = np.log(c / c.sum(axis=1, keepdims=True)).ravel()
    return flat


def lanes(texts: list[np.ndarray], width: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(inputs, targets, starts, places): arrays of lanes x steps, targets -1 where a lane has ended.

    A text's inputs are its symbols one step late, `first` before them. places: each text's lane,
    first step and length. The longest texts are placed first, each on the shortest lane; longer
    lanes come first, so that those that have not ended stand together.
    """
    import heapq

    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    free = [(0, lane) for lane in range(min(width, max(1, len(texts))))]
    places: list[tuple[int, int, int]] = [(0, 0, 0)] * len(texts)
    for i in order:
        at, lane = heapq.heappop(free)
        places[i] = (lane, at, len(texts[i]))
        heapq.heappush(free, (at + len(texts[i]), lane))
    rank = {lane: k for k, (_, lane) in enumerate(sorted(free, reverse=True))}
    places = [(rank[lane], at, n) for lane, at, n in places]
    steps = max(at for at, _ in free)
    targets = np.full((len(free), steps), -1, "int16")
    inputs = np.full((len(free), steps), first, "int16")
    starts = np.zeros((len(free), steps), bool)
    for t, (lane, at, n) in zip(texts, places, strict=True):
        targets[lane, at : at + n] = t
        inputs[lane, at + 1 : at + n] = t[:-1]
        starts[lane, at] = True
    return inputs, targets, starts, places


def _log_shares(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-share of the wanted row of each column of scores, sums of x); x becomes shares but for division by the sums."""
    x -= x.max(axis=0)
    logp = x[wanted, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return logp - np.log(total), total


def _error(x: np.ndarray, total: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """d(-sum of log-shares)/d(scores), in place of what _log_shares left in x."""
    x /= total
    x[wanted, np.arange(x.shape[1])] -= 1
    return x


def outputs(p: dict[str, np.ndarray], h: np.ndarray, targets: np.ndarray, grad: dict[str, np.ndarray] | None = None):
    """Natural log-probabilities of targets given rows of states; with grad, also d(-sum)/dh, and grad is added to.

    States are put in the order of their classes, and turned so that sums over symbols run along columns.
    """
    cls = targets // MEMBERS
    order = np.argsort(cls, kind="stable")
    cls, ht = cls[order].astype("intp"), np.ascontiguousarray(h[order].T)
    member = targets[order] - cls * MEMBERS
    x = p["vc"].T @ ht
    x += p["bc"][:, None]
    found, total = _log_shares(x, cls)
    dht = None
    if grad is not None:
        d = _error(x, total, cls)
        grad["vc"] += ht @ d.T
        grad["bc"] += d.sum(axis=1)
        dht = p["vc"] @ d
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        at = slice(ends[c], ends[c + 1])
        if at.start == at.stop:
            continue
        own = slice(c * MEMBERS, (c + 1) * MEMBERS)
        x = p["vw"][own] @ ht[:, at]
        x += p["bw"][own][:, None]
        logp, total = _log_shares(x, member[at])
        found[at] += logp
        if grad is not None:
            d = _error(x, total, member[at])
            grad["vw"][own] += d @ ht[:, at].T
            grad["bw"][own] += d.sum(axis=1)
            dht[:, at] += p["vw"][own].T @ d
    logp = np.empty_like(found)
    logp[order] = found
    if grad is None:
        return logp, None
    dh = np.empty_like(h)
    dh[order] = dht.T
    return logp, dh


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Rows of three gates as three arrays."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def _run(p, given, starts, h, kept=None) -> np.ndarray:
    """States of steps x lanes; with kept, also what the way back needs.

    Gates are halved sums, since a sigmoid is half a tanh of half its sum and a half. They lie one behind
    the other (gates x lanes x HIDDEN), so that each step's sums run over whole blocks of memory.
    """
    H = HIDDEN
    half = np.repeat(np.array([0.5, 0.5, 1.0], h.dtype), H)
    gx, wh = np.take(_by_gate(half * (p["emb"] @ p["wx"] + p["b"])), given, axis=1), _by_gate(half * p["wh"])
    n_steps, n = given.shape
    states = np.empty((n_steps, n, H), h.dtype)
    if kept is not None:
        kept |= {"zr": np.empty((n_steps, 2, n, H), h.dtype), "new": np.empty_like(states), "back": np.empty_like(states), "before": np.empty_like(states)}
    fresh = starts.any(axis=1)
    gh = np.empty((3, n, H), h.dtype)
    zr, new = np.empty((2, n, H), h.dtype), np.empty((n, H), h.dtype)
    for t in range(n_steps):
        if fresh[t]:
            h = np.where(starts[t][:, None], np.zeros((), h.dtype), h)
        if kept is not None:
            zr, new = kept["zr"][t], kept["new"][t]
            kept["before"][t] = h
        np.matmul(h, wh, out=gh)
        np.add(gx[:2, t], gh[:2], out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        if kept is not None:
            kept["back"][t] = gh[2]
        np.multiply(zr[1], gh[2], out=new)
        new += gx[2, t]
        np.tanh(new, out=new)
        out = states[t]
        np.subtract(h, new, out=out)
        out *= zr[0]
        out += new
        h = out
    return states


def score(flat: np.ndarray, texts: list[np.ndarray], first: int, width: int = 256, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole text."""
    if not texts:
        return np.zeros(0)
    p = views(flat)
    inputs, targets, starts, places = lanes(texts, width, first)
    n, steps = targets.shape
    given, starts, ends = np.ascontiguousarray(inputs.T), np.ascontiguousarray(starts.T), (targets >= 0).sum(axis=1)
    h = np.zeros((n, HIDDEN), "float32")
    logs = np.zeros((n, steps), "float32")
    for a in range(0, steps, window):
        b, k = min(a + window, steps), int((ends > a).sum())  # lanes that have not ended
        states = _run(p, given[a:b, :k], starts[a:b, :k], h[:k])
        h = states[-1]
        wanted = targets[:k, a:b].T.reshape(-1)
        live = np.flatnonzero(wanted >= 0)
        part = np.zeros(len(wanted), "float32")
        part[live] = outputs(p, states.reshape(-1, HIDDEN)[live], wanted[live])[0]
        logs[:k, a:b] = part.reshape(b - a, k).T
    return np.array([logs[lane, at : at + k].sum(dtype="float64") for lane, at, k in places])


def window_gradient(p, inputs, targets, starts, h):
    """(mean loss, flat gradient, last state) of one window of lanes x steps."""
    flat = np.zeros(SIZE, p["emb"].dtype)
    g, H = views(flat), HIDDEN
    given, starts = np.ascontiguousarray(inputs.T), np.ascontiguousarray(starts.T)
    kept: dict[str, np.ndarray] = {}
    states = _run(p, given, starts, h, kept)
    n_steps, n, _ = states.shape
    wanted = targets.T.reshape(-1)
    live = np.flatnonzero(wanted >= 0)
    every = states.reshape(-1, H)
    logp, dlive = outputs(p, every if len(live) == len(wanted) else every[live], wanted[live], g)
    dall = np.zeros_like(every)
    dall[live] = dlive
    dall = dall.reshape(states.shape)
    z, r, new = kept["zr"][:, 0], kept["zr"][:, 1], kept["new"]
    to_z, to_new, to_r = (kept["before"] - new) * z * (1 - z), (1 - z) * (1 - new * new), kept["back"] * r * (1 - r)
    dgx, dback = np.empty((3, n_steps, n, H), h.dtype), np.empty((n_steps, n, H), h.dtype)  # dback: of the last gate's share of the state
    back, fresh = np.ascontiguousarray(_by_gate(p["wh"]).transpose(0, 2, 1)), starts.any(axis=1)
    dh, part = np.zeros((n, H), h.dtype), np.empty((n, H), h.dtype)
    for t in range(n_steps - 1, -1, -1):
        d = dall[t]
        d += dh
        np.multiply(d, to_z[t], out=dgx[0, t])
        np.multiply(d, to_new[t], out=dgx[2, t])
        np.multiply(dgx[2, t], to_r[t], out=dgx[1, t])
        np.multiply(dgx[2, t], r[t], out=dback[t])
        np.matmul(dback[t], back[2], out=dh)
        for k in (0, 1):
            np.matmul(dgx[k, t], back[k], out=part)
            dh += part
        d *= z[t]
        dh += d
        if fresh[t]:
            dh[starts[t]] = 0
    before, dgx = kept["before"].reshape(-1, H).T, dgx.reshape(3, -1, H)
    for k, d in enumerate((dgx[0], dgx[1], dback.reshape(-1, H))):
        g["wh"][:, k * H : (k + 1) * H] += before @ d
    seen = given.reshape(-1)
    order = np.argsort(seen, kind="stable")
    symbols, first = np.unique(seen[order], return_index=True)
    dtable = np.hstack([np.add.reduceat(d[order], first, axis=0) for d in dgx])
    g["emb"][symbols] += dtable @ p["wx"].T
    g["wx"] += p["emb"][symbols].T @ dtable
    g["b"] += dtable.sum(axis=0)
    count = max(1, len(live))
    return -logp.sum() / count, flat / count, states[-1]


def train(flat: np.ndarray, texts: list[np.ndarray], first: int, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """Parameters after one pass of Adam steps, a window a step, and the number of symbols seen."""
    flat = flat.copy()
    if not texts:
        return flat, 0
    p = views(flat)
    total = sum(map(len, texts))
    width = max(LEAST_LANES, total // max(LANE_SYMBOLS, *map(len, texts)))
    inputs, targets, starts, _ = lanes(texts, min(LANES, width), first)
    ends, steps = (targets >= 0).sum(axis=1), targets.shape[1]
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    h = np.zeros((len(inputs), HIDDEN), "float32")
    most = min(MOST_SYMBOLS, max(LEAST_SYMBOLS, total // WINDOWS))
    a = k = done = 0
    while a < steps:
        live = int((ends > a).sum())
        b, k = a + min(MOST_STEPS, max(LEAST_STEPS, most // live)), k + 1
        _, grad, h = window_gradient(p, inputs[:live, a:b], targets[:live, a:b], starts[:live, a:b], h[:live])
        grad *= min(1.0, 1.0 / (float(np.sqrt(grad @ grad)) + 1e-9))
        m += 0.1 * (grad - m)
        grad *= grad
        v += 0.01 * (grad - v)
        done += int((targets[:live, a:b] >= 0).sum())
        flat -= rate * (1 - 0.9 * done / total) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        a = b
    return flat, total
