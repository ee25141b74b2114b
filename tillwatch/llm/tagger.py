"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, decoding, nothing of Spark.

All arrays of a batch are (time, direction, window, unit); the backward direction reads the windows reversed, so both run in
the same matrix products.  The embedding and the input weights are one table, a row for each character class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(classes: int, hidden: int, tags: int, seed: int, kind: type = np.float32) -> Params:
    """Starting weights: `table` (2, classes, 4 * hidden), `loop`, `bias`, `out`, `out_bias`, `step` (tag to tag), `first`."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, width: (rng.standard_normal(shape) * width).astype(kind)
    bias = np.zeros((2, 1, 4 * hidden), dtype=kind)
    bias[:, :, hidden : 2 * hidden] = 1.0  # remember at first
    return {
        "table": draw(2, classes, 4 * hidden, width=0.3),
        "loop": draw(2, hidden, 4 * hidden, width=hidden**-0.5),
        "bias": bias,
        "out": draw(2 * hidden, tags, width=(2 * hidden) ** -0.5),
        "out_bias": np.zeros(tags, dtype=kind),
        "step": draw(tags, tags, width=0.01),
        "first": np.zeros(tags, dtype=kind),
    }


@dataclass
class Trace:
    gates: np.ndarray
    cells: np.ndarray
    squashed: np.ndarray
    states: np.ndarray


def run(params: Params, codes: np.ndarray, trace: bool = False) -> tuple[np.ndarray, Trace | None]:
    """Emission scores (time, window, tag) of character codes (window, time)."""
    n, time = codes.shape
    table, loop, bias = params["table"], params["loop"], params["bias"]
    hidden = loop.shape[1]
    kind = table.dtype
    state, cell = np.zeros((2, n, hidden), kind), np.zeros((2, n, hidden), kind)
    states = np.empty((time, 2, n, hidden), kind)
    if trace:
        gates, cells, squashed = np.empty((time, 2, n, 4 * hidden), kind), np.empty_like(states), np.empty_like(states)
    table = table + bias
    for t in range(time):
        z = state @ loop
        z[0] += table[0][codes[:, t]]
        z[1] += table[1][codes[:, time - 1 - t]]
        z[..., : 3 * hidden] = sigmoid(z[..., : 3 * hidden])
        z[..., 3 * hidden :] = np.tanh(z[..., 3 * hidden :])
        cell = z[..., hidden : 2 * hidden] * cell + z[..., :hidden] * z[..., 3 * hidden :]
        high = np.tanh(cell)
        state = z[..., 2 * hidden : 3 * hidden] * high
        states[t] = state
        if trace:
            gates[t], cells[t], squashed[t] = z, cell, high
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
    emissions = both @ params["out"] + params["out_bias"]
    return emissions, Trace(gates, cells, squashed, states) if trace else None


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(params: Params, codes: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of the tag paths (window, time) and its gradient."""
    n, time = codes.shape
    emissions, trace = run(params, codes, trace=True)
    assert trace is not None
    step, first = params["step"], params["first"]
    count = emissions.shape[2]
    rows = np.arange(n)
    ahead = np.empty_like(emissions)
    ahead[0] = first + emissions[0]
    for t in range(1, time):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + step, 1) + emissions[t]
    behind = np.zeros_like(emissions)
    for t in range(time - 2, -1, -1):
        behind[t] = log_sum(step + (emissions[t + 1] + behind[t + 1])[:, None, :], 2)
    total = log_sum(ahead[-1], 1)
    path = tags.T
    own = first[path[0]] + np.take_along_axis(emissions, path[:, :, None], 2)[..., 0].sum(axis=0)
    own = own + step[path[:-1], path[1:]].sum(axis=0)
    share = np.exp(ahead + behind - total[None, :, None])
    share[np.arange(time)[:, None], rows, path] -= 1
    d_emissions = share / n
    d_step = np.zeros_like(step)
    for t in range(1, time):
        pair = ahead[t - 1][:, :, None] + step + (emissions[t] + behind[t])[:, None, :] - total[:, None, None]
        d_step += np.exp(pair).sum(axis=0)
    np.subtract.at(d_step, (path[:-1].ravel(), path[1:].ravel()), 1)
    grad = {"step": d_step / n, "first": d_emissions[0].sum(axis=0)}
    both = np.concatenate([trace.states[:, 0], trace.states[::-1, 1]], axis=-1)
    grad["out"] = np.tensordot(both, d_emissions, axes=([0, 1], [0, 1]))
    grad["out_bias"] = d_emissions.sum(axis=(0, 1))
    d_both = d_emissions @ params["out"].T
    hidden = params["loop"].shape[1]
    d_states = np.stack([d_both[..., :hidden], d_both[::-1, :, hidden:]], axis=1)
    grad["table"], grad["loop"] = np.zeros_like(params["table"]), np.zeros_like(params["loop"])
    back = params["loop"].transpose(0, 2, 1)
    d_state, d_cell = np.zeros_like(trace.states[0]), np.zeros_like(trace.states[0])
    inputs = np.empty_like(trace.gates)
    for t in range(time - 1, -1, -1):
        g, high = trace.gates[t], trace.squashed[t]
        into, keep, show, new = (g[..., i * hidden : (i + 1) * hidden] for i in range(4))
        d_state = d_state + d_states[t]
        d_cell = d_cell + d_state * show * (1 - high * high)
        before = trace.cells[t - 1] if t else np.zeros_like(high)
        d_z = np.concatenate(
            [d_cell * new * into * (1 - into), d_cell * before * keep * (1 - keep), d_state * high * show * (1 - show), d_cell * into * (1 - new * new)],
            axis=-1,
        )
        if t:
            grad["loop"] += trace.states[t - 1].transpose(0, 2, 1) @ d_z
        inputs[t] = d_z
        d_state, d_cell = d_z @ back, d_cell * keep
    grad["bias"] = inputs.sum(axis=(0, 2))[:, None, :]
    for way, read in enumerate((codes.T, codes.T[::-1])):
        seen = np.zeros((time * n, len(params["table"][0])), dtype=inputs.dtype)
        seen[np.arange(time * n), read.ravel()] = 1
        grad["table"][way] = seen.T @ inputs[:, way].reshape(time * n, -1)
    return float((total - own).mean()), grad


def fit(params: Params, codes: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> list[float]:
    """Adam on shuffled batches, the rate falling to a tenth; changes the parameters and returns the losses."""
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    losses, order = [], np.empty(0, dtype=int)
    for i in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(codes))])
        chosen, order = order[:batch], order[batch:]
        loss, grad = loss_and_gradient(params, codes[chosen], tags[chosen])
        losses.append(loss)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * (1 - 0.9 * i / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            params[k] -= (now * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.999**i)) + 1e-8)).astype(params[k].dtype)
    return losses


def best_paths(params: Params, emissions: np.ndarray) -> np.ndarray:
    """The likeliest tags (window, time) of emission scores; of equally likely ones the smallest tag."""
    time, n, count = emissions.shape
    step = params["step"].T  # to, from
    best = params["first"] + emissions[0]
    came = np.empty((time, n, count), dtype=np.int8)
    for t in range(1, time):
        options = best[:, None, :] + step
        came[t] = options.argmax(axis=2)
        best = options.max(axis=2) + emissions[t]
    path = np.empty((n, time), dtype=np.int8)
    path[:, -1] = best.argmax(axis=1)
    for t in range(time - 1, 0, -1):
        path[:, t - 1] = came[t][np.arange(n), path[:, t]]
    return path
