"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state across windows.

Documents lie one after the other in parallel slots. A window takes the next STEPS tokens of every slot; the state goes
on into the next window and is set to zero where a document begins, so a document is scored as a whole, while gradients
end at the window's edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Width of the state and of embeddings, steps of a window, slots when learning and when scoring.
STATE, STEPS, SLOTS, SCORE_SLOTS = 16, 16, 512, 1024
#: Step size of AdaGrad; updates that a pass over few documents takes, as far as LEAST slots give them.
RATE, UPDATES, LEAST = 0.08, 200, 16
#: Tokens of a piece that is learnt from; scores never cut a document.
LONGEST = 512


class Layout:
    """What a code stands for: `words` frequent words in `edges` ranges (one class each), then tail codes in groups of
    `buckets`, of which `tail_class` names the class. A class is predicted from the state, and a frequent word in its
    class; what lies below a tail class is not the network's."""

    def __init__(self, edges: np.ndarray, tail_class: np.ndarray, buckets: int):
        self.words, self.edges, self.buckets = int(edges[-1]) if len(edges) else 0, edges, buckets
        ranges = max(len(edges) - 1, 0)
        self.classes = ranges + int(tail_class.max(initial=-1)) + 1
        head = np.repeat(np.arange(ranges), np.diff(edges)) if ranges else np.zeros(0, np.int64)
        self.class_of = np.concatenate([head, np.repeat(np.where(tail_class >= 0, ranges + tail_class, 0), buckets)]).astype(np.int64)

    def start(self, class_share: np.ndarray, word_share: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
        """Weights that give the shares of classes and of words in their class, whatever the state."""
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(STATE)).astype(np.float32)
        return {"embed": small(len(self.class_of), 3 * STATE), "wh": small(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32),
                "wc": small(STATE, self.classes) * np.float32(0.1), "bc": np.log(class_share).astype(np.float32),
                "u": small(self.words, STATE) * np.float32(0.1), "bu": np.log(word_share).astype(np.float32)}


def windows(codes: list[np.ndarray], slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(previous codes, codes, document numbers) by step and slot; -1 before a document's first token, and document -1
    where a slot has ended. Longest documents are dealt first, each to the least filled slot."""
    size, rng = np.array([len(c) for c in codes]), np.random.default_rng(len(codes))
    slots = min(slots, len(codes))
    loads, dealt = [(0, s) for s in range(slots)], [[] for _ in range(slots)]
    for i in np.argsort(-size, kind="stable").tolist():
        held, s = heapq.heappop(loads)
        dealt[s].append(i)
        heapq.heappush(loads, (held + int(size[i]), s))
    for d in dealt:
        rng.shuffle(d)  # long documents first would leave the short ones to the end
    dealt.sort(key=lambda d: -int(size[d].sum()))  # slots that end first are last, so a window can leave them out
    held = np.array([int(size[d].sum()) for d in dealt])
    whole = [i for d in dealt for i in d]
    code, doc = np.concatenate([codes[i] for i in whole]), np.repeat(whole, size[whole])
    begin = np.cumsum(held) - held
    first = np.ones(len(code), bool)
    first[1:] = doc[1:] != doc[:-1]
    step = np.arange(STEPS)[:, None]
    for at in range(0, int(held[0]), STEPS):
        live = int((held > at).sum())
        there = at + step < held[:live]
        place = np.minimum(begin[:live] + at + step, len(code) - 1)
        before = np.where(first[place] | ~there, -1, code[np.maximum(place - 1, 0)])
        yield before, np.where(there, code[place], -1), np.where(there, doc[place], -1)


def forward(p: dict, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """States after every step, and what the backward pass needs. An embedding is what its code adds to the gates."""
    begins = before < 0
    any_begin = begins.any(1)
    gates = p["embed"][np.maximum(before, 0)]
    gates[begins] = 0
    gates += p["b"]
    out, kept = np.empty((*before.shape, STATE), p["wh"].dtype), []
    n = STATE
    for t in range(len(before)):
        if any_begin[t]:
            h = h.copy()
            h[begins[t]] = 0
        inner = h @ p["wh"]
        rz = gates[t, :, :2 * n] + inner[:, :2 * n]
        rz *= 0.5  # the logistic function by tanh
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        new = rz[:, :n] * inner[:, 2 * n:]
        new += gates[t, :, 2 * n:]
        np.tanh(new, out=new)
        kept.append((h, rz[:, :n], rz[:, n:], new, inner[:, 2 * n:]))
        h = np.multiply(rz[:, n:], h - new, out=out[t])
        h += new
    return out, kept


def by_class(layout: Layout, code: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, rows) of every class of frequent words among the codes."""
    order = np.argsort(kind, kind="stable")
    at = np.searchsorted(kind[order], np.arange(len(layout.edges)))
    for k in range(len(layout.edges) - 1):
        if at[k] < at[k + 1]:
            yield int(layout.edges[k]), int(layout.edges[k + 1]), order[at[k]:at[k + 1]]


def of_target(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each row's target under the softmax of h @ w + b, the exponentials, and their sums."""
    x = h @ w
    x += b
    if np.abs(w).sum(0).max() + np.abs(b).max() > 60:  # states lie between -1 and 1, so else no exponential overflows
        x -= x.max(1, keepdims=True)
    got = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return got - np.log(total), x, total


def predicted(p: dict, layout: Layout, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """Log-probability of each code after its state; gradients of their negative sum, and of the states."""
    kind = layout.class_of[code]
    got, d, total = of_target(h, p["wc"], p["bc"], kind)
    d /= total[:, None]
    d[np.arange(len(code)), kind] -= 1
    grads = {"wc": h.T @ d, "bc": d.sum(0), "u": np.zeros_like(p["u"]), "bu": np.zeros_like(p["bu"])}
    dh = d @ p["wc"].T
    for a, b, rows in by_class(layout, code, kind):
        mine, state = code[rows] - a, h[rows]
        more, d, total = of_target(state, p["u"][a:b].T, p["bu"][a:b], mine)
        got[rows] += more
        d /= total[:, None]
        d[np.arange(len(rows)), mine] -= 1
        grads["u"][a:b] = d.T @ state
        grads["bu"][a:b] = d.sum(0)
        dh[rows] += d @ p["u"][a:b]
    return got, grads, dh


def log_probabilities(p: dict, layout: Layout, h: np.ndarray, code: np.ndarray) -> np.ndarray:
    kind = layout.class_of[code]
    got = of_target(h, p["wc"], p["bc"], kind)[0]
    for a, b, rows in by_class(layout, code, kind):
        got[rows] += of_target(h[rows], p["u"][a:b].T, p["bu"][a:b], code[rows] - a)[0]
    return got


def gradients(p: dict, layout: Layout, before: np.ndarray, now: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss of a window, its gradients (those of embeddings as (rows, sums)), and the state after it."""
    states, kept = forward(p, before, h)
    there = now >= 0
    got, grads, dflat = predicted(p, layout, states[there], now[there])
    dout = np.zeros_like(states)
    dout[there] = dflat
    n, begins = STATE, before < 0
    any_begin = begins.any(1)
    dgates, dinner = (np.empty((*before.shape, 3 * n), states.dtype) for _ in range(2))
    carry = np.zeros_like(states[0])
    back = np.ascontiguousarray(p["wh"].T)
    for t in range(len(before) - 1, -1, -1):
        h0, r, z, new, inner = kept[t]
        dh = dout[t]
        dh += carry
        carry = dh * z
        dnew = (dh - carry) * (1 - new * new)
        g = dgates[t]
        np.multiply(dnew * inner, r * (1 - r), out=g[:, :n])
        np.multiply(dh * (h0 - new), z * (1 - z), out=g[:, n:2 * n])
        g[:, 2 * n:] = dnew
        dinner[t] = g
        dinner[t, :, 2 * n:] *= r
        carry += dinner[t] @ back
        if any_begin[t]:
            carry[begins[t]] = 0
    flat = dgates.reshape(-1, 3 * n)
    grads |= {"wh": np.concatenate([k[0] for k in kept]).T @ dinner.reshape(-1, 3 * n), "b": flat.sum(0)}
    dx, row = flat[~begins.ravel()], before[~begins]
    order = np.argsort(row, kind="stable")
    rows, at = np.unique(row[order], return_index=True)
    grads["embed"] = rows, np.add.reduceat(dx[order], at) if len(rows) else dx
    return -float(got.sum(dtype=np.float64)), grads, states[-1]


def learn(p: dict, squares: dict, layout: Layout, codes: list[np.ndarray], slots: int = SLOTS) -> None:
    """One pass over the documents; weights and sums of squared gradients are changed in place.

    Long documents are cut into pieces here, so slots end together: a slot that went on alone would pull the weights to
    its document. Every token weighs the same, in full windows and in the last ones.
    """
    h = None
    codes = [c[i:i + LONGEST] for c in codes for i in range(0, len(c), LONGEST)]
    slots = max(min(slots, sum(map(len, codes)) // (STEPS * UPDATES)), LEAST)
    scale = np.float32((slots * STEPS) ** -0.5)
    for before, now, _ in windows(codes, slots):
        h = np.zeros((before.shape[1], STATE), np.float32) if h is None else h[:before.shape[1]]
        _, grads, h = gradients(p, layout, before, now, h)
        for name, g in grads.items():
            rows, g = g if name == "embed" else (slice(None), g)
            g = g * scale
            squares[name][rows] += g * g
            p[name][rows] -= np.float32(RATE) * g / np.sqrt(squares[name][rows] + np.float32(1e-2))


def score(p: dict, layout: Layout, codes: list[np.ndarray], slots: int = SCORE_SLOTS) -> np.ndarray:
    """Natural log-probability of each whole document."""
    total, h = np.zeros(len(codes)), None
    for before, now, doc in windows(codes, slots):
        h = np.zeros((before.shape[1], STATE), np.float32) if h is None else h[:before.shape[1]]
        states, _ = forward(p, before, h)
        h, there = states[-1], now >= 0
        total += np.bincount(doc[there], log_probabilities(p, layout, states[there], now[there]), minlength=len(codes))
    return total
