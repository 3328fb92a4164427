"""Plain-loop versions of what the operators compute, written from the rules."""

from __future__ import annotations

import math

import numpy as np


def shown_slots(sizes, groups, k, floor):
    """The slot whose risk set is shown at each slot. sizes: rows at risk; groups: for each group, its rows at risk."""
    if k <= 1:
        return list(range(len(sizes)))
    tables = [sizes] + [g for own in groups for g in (own, [n - m for n, m in zip(sizes, own)])]
    out, last = [0], 0
    for slot in range(1, len(sizes)):
        lost = [t[last] - t[slot] for t in tables]
        hidden = any(0 < x < k for x in lost) or (floor is not None and any(t[slot] < floor for t in tables))
        last = last if hidden else slot
        out.append(last)
    return out


def merge(time, freq, least):
    out, group, held, last = [], [], 0, None
    for t, f in zip(time, freq):
        group.append(t)
        held += f
        if held >= least:
            out += [t] * len(group)
            last, group, held = t, [], 0
    return out + [last if last is not None else time[-1]] * len(group)


def breslow(rows, names=(3, 4)):
    """A direct maximum of the Breslow likelihood over pooled rows: coefficients, errors, log-likelihood."""
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([[r[i] for i in names] for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        ll, g, h = 0.0, np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        w = np.exp(x @ beta)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            s0, s1 = w[at].sum(), w[at] @ x[at]
            ll += x[i] @ beta - math.log(s0)
            g += x[i] - s1 / s0
            h -= (x[at] * w[at, None]).T @ x[at] / s0 - np.outer(s1, s1) / s0**2
        step = np.linalg.solve(h, g)
        if np.abs(step).max() < 1e-10:
            break
        beta = beta - step
    return beta, np.sqrt(np.diag(np.linalg.inv(-h))), ll


def held_share(rows, k, floor, least):
    """Share of one site's events that are scored against the first risk set without being at its slot."""
    times = sorted(r[1] for r in rows)
    cut = times[-k] if k > 1 else math.inf
    rows = [(min(t, cut), int(e and t <= cut)) for _, t, e, *_ in rows]
    seen: dict = {}
    for t, e in rows:
        if e:
            seen[t] = seen.get(t, 0) + 1
    points = sorted(seen)
    to = dict(zip(points, merge(points, [seen[t] for t in points], least)))
    rows = [(to[t] if e else t, e) for t, e in rows]
    return rows, sorted(set(to.values()))
