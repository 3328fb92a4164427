"""The learning algorithms against plain versions of what they minimise."""

import numpy as np
import pyarrow as pa

from hazardspark.llm.arrays import chunks
from hazardspark.llm.quality import dual_coordinate_descent
from hazardspark.llm.toxicity import DIM, FILTERS, WIDTHS, Model, _maxima, gradients, word_rows


def test_dual_coordinate_descent_reaches_the_optimum():
    """The hinge loss it ends with is that of projected gradient steps on the dense dual."""
    rng = np.random.default_rng(0)
    n, m = 60, 25
    rows = [np.sort(rng.choice(m, rng.integers(2, 8), replace=False)) for _ in range(n)]
    label, scale, cost = (rng.random(n) < 0.4).astype(int), rng.normal(size=m), rng.uniform(0.2, 1.5, n)
    x = np.zeros((n, m + 1))
    for i, f in enumerate(rows):
        x[i, f] = scale[f] / np.linalg.norm(scale[f])
    x[:, m] = 1
    y = np.where(label == 1, 1.0, -1.0)
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))
    alpha, gram = np.zeros(n), (x * y[:, None]) @ (x * y[:, None]).T
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - rate * (gram @ alpha - 1), 0, cost)
    weight, bias = dual_coordinate_descent(rows, label, scale, cost, rounds=2000)
    want, got = loss((alpha * y) @ x), loss(np.append(weight, bias))
    assert abs(got - want) < 2e-3 * want


def test_gradients_of_the_convolutional_classifier():
    """Against differences of the loss, for every kind of parameter."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 15))) for _ in range(9)] + [""]
    (chunk,) = chunks(pa.record_batch({"doc_id": pa.array(range(10), pa.int64()), "text": texts}))
    part = word_rows(chunk)
    model = Model()
    model._where = _maxima
    spots = np.unique(part[0])
    model.table[spots] = rng.normal(0, 0.5, (len(spots), DIM))
    y, weight = (rng.random(10) < 0.5).astype(float), rng.uniform(0.5, 1.5, 10)

    def loss():
        margin = model.margin_of(model.pooled(*part)[0]).astype(float)
        return float(weight @ (np.logaddexp(0, margin) - y * margin))

    grads, by_bias, spot, by_table = gradients(model, *part, y, weight)
    assert len(grads) == len(WIDTHS) + 2 and len(grads[-1]) == len(WIDTHS) * FILTERS
    told, seen = [], []

    def compare(array, at, want, step=2e-3):
        old = array[at]
        array[at] = old + step
        high = loss()
        array[at] = old - step
        low = loss()
        array[at] = old
        told.append(float(want))
        seen.append((high - low) / (2 * step))

    for values, grad in zip((*model.filters, model.shift, model.out), grads):
        for at in rng.choice(values.size, 25):
            compare(values.reshape(-1), at, grad.reshape(-1)[at])
    for i in rng.choice(len(spot), min(len(spot), 20), replace=False):
        compare(model.table, (spot[i], 3), by_table[i, 3])
    model.bias = np.array([model.bias])
    compare(model.bias, 0, by_bias)
    told, seen = np.array(told), np.array(seen)
    # a step over the edge of a maximum shows as a difference here and there
    assert np.mean(np.abs(told - seen) < 0.02 + 0.05 * np.abs(seen)) > 0.95 and np.corrcoef(told, seen)[0, 1] > 0.98
