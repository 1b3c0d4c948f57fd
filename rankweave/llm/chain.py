"""Two-state linear chains: forward-backward over many rows at once, and Viterbi over one."""

from __future__ import annotations

import numpy as np

COLUMNS = 128  # forward-backward runs over so many tokens of each column at once


def odds(x: np.ndarray, first: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1. x: odds that a token itself gives; first: whether it begins a row.

    a: 2 by 2 transition potentials; start: odds of state 1 at a row's first token. Forward and backward odds
    are compositions of fractional linear maps r -> (p r + q) / (s r + t), so all columns of a batch are
    composed at once, the columns' results are chained, and a second pass fills in every token.
    """
    n = len(x)
    if not n:
        return np.zeros(0), np.zeros(0)
    (a00, a01), (a10, a11) = a
    p, q = np.where(first, 0.0, a11 * x), np.where(first, start * x, a01 * x)
    s, t = np.where(first, 0.0, a10), np.where(first, 1.0, a00)
    ahead = _scan(p, q, s, t)
    # backward, from the last token: b_i = (a11 x b + a10) / (a01 x b + a00) with x and b of the next token
    nx, end = np.append(x[1:], 1.0), np.append(first[1:], True)
    p, q = np.where(end, 0.0, a11 * nx), np.where(end, 1.0, a10)
    s, t = np.where(end, 0.0, a01 * nx), np.where(end, 1.0, a00)
    return ahead, _scan(p[::-1], q[::-1], s[::-1], t[::-1])[::-1]


def marginals(x: np.ndarray, first: np.ndarray, a: np.ndarray, start: float) -> np.ndarray:
    """P(state 1) of each token."""
    both = np.multiply(*odds(x, first, a, start))
    return both / (1 + both)


def pair_counts(x: np.ndarray, first: np.ndarray, a: np.ndarray, start: float, known: tuple | None = None) -> np.ndarray:
    """Expected numbers of the four transitions inside rows. known: the odds, where they are at hand."""
    ahead, behind = known or odds(x, first, a, start)
    r, b = ahead[:-1], x[1:] * behind[1:]
    each = np.array([np.full(len(r), a[0, 0]), a[0, 1] * b, a[1, 0] * r, a[1, 1] * r * b])[:, ~first[1:]]
    return (each / each.sum(0)).sum(1).reshape(2, 2)


def _scan(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """r_i = (p_i r_(i-1) + q_i) / (s_i r_(i-1) + t_i) for all i; the first map must be constant."""
    n = len(p)
    high = min(COLUMNS, n)
    wide = -(-n // high)
    pad = wide * high - n
    p, q, s, t = (np.append(v, np.full(pad, f)).reshape(wide, high).T for v, f in ((p, 1.0), (q, 0.0), (s, 0.0), (t, 1.0)))
    P, Q, S, T = (v[0].copy() for v in (p, q, s, t))
    for i in range(1, high):
        P, Q, S, T = p[i] * P + q[i] * S, p[i] * Q + q[i] * T, s[i] * P + t[i] * S, s[i] * Q + t[i] * T
        norm = P + Q + S + T
        P, Q, S, T = P / norm, Q / norm, S / norm, T / norm
    r, enter = 1.0, np.empty(wide)
    for j in range(wide):
        enter[j] = r
        r = (P[j] * r + Q[j]) / (S[j] * r + T[j])
    out, r = np.empty((high, wide)), enter
    for i in range(high):
        r = (p[i] * r + q[i]) / (s[i] * r + t[i])
        out[i] = r
    return out.T.reshape(-1)[:n]


def viterbi(score: list[float], log_a: list[list[float]], start: float) -> list[int]:
    """The likeliest states of one row. score: log odds that a token itself gives; start: log odds at the first."""
    if not score:
        return []
    (t00, t01), (t10, t11) = log_a
    zero, one, back = 0.0, start + score[0], []
    for s in score[1:]:
        to0, to1 = zero + t00 >= one + t10, zero + t01 > one + t11
        back.append((0 if to0 else 1, 0 if to1 else 1))
        zero, one = max(zero + t00, one + t10), max(zero + t01, one + t11) + s
    states = [int(one > zero)]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]
