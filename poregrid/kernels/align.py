"""Sequence alignment and superposition of structures."""

from __future__ import annotations

import numpy as np


def global_alignment(a: str, b: str, score, open_gap: float = -10.0, extend_gap: float = -0.5) -> list[tuple[int, int]]:
    """Aligned index pairs of the best global alignment with affine gaps. ``score(x, y)`` rates two letters."""
    n, m = len(a), len(b)
    low = -1e18
    match, up, left = (np.full((n + 1, m + 1), low) for _ in range(3))
    match[0, 0] = 0.0
    for i in range(1, n + 1):
        up[i, 0] = open_gap + (i - 1) * extend_gap
    for j in range(1, m + 1):
        left[0, j] = open_gap + (j - 1) * extend_gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            match[i, j] = max(match[i - 1, j - 1], up[i - 1, j - 1], left[i - 1, j - 1]) + score(a[i - 1], b[j - 1])
            up[i, j] = max(max(match[i - 1, j], left[i - 1, j]) + open_gap, up[i - 1, j] + extend_gap)
            left[i, j] = max(max(match[i, j - 1], up[i, j - 1]) + open_gap, left[i, j - 1] + extend_gap)
    pairs, i, j = [], n, m
    tables = (match, up, left)
    state = int(np.argmax([t[n, m] for t in tables]))
    while i or j:
        here = tables[state][i, j]
        if state == 0:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
            state = int(np.argmax([t[i, j] for t in tables]))
        elif state == 1:
            i -= 1
            before = [match[i, j] + open_gap, up[i, j] + extend_gap, left[i, j] + open_gap]
            state = int(np.argmin([abs(v - here) for v in before]))
        else:
            j -= 1
            before = [match[i, j] + open_gap, up[i, j] + open_gap, left[i, j] + extend_gap]
            state = int(np.argmin([abs(v - here) for v in before]))
    return pairs[::-1]


def superpose(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, float]:
    """The 4x4 rigid transform that best lays ``moving`` on ``fixed``, and the RMSD after it."""
    mc, fc = moving.mean(0), fixed.mean(0)
    u, _, vt = np.linalg.svd((moving - mc).T @ (fixed - fc))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    rotation = vt.T @ flip @ u.T
    matrix = np.eye(4)
    matrix[:3, :3], matrix[:3, 3] = rotation, fc - rotation @ mc
    moved = moving @ rotation.T + matrix[:3, 3]
    return matrix, float(np.sqrt(((moved - fixed) ** 2).sum(1).mean()))


def superpose_rejecting(moving: np.ndarray, fixed: np.ndarray, far: float = 2.0, rounds: int = 5, settled: float = 0.1) -> tuple[np.ndarray, float]:
    """Superposition repeated without the atoms that stay far apart, until the RMSD settles.

    An atom is far if the root of its squared deviation over three exceeds ``far``.
    """
    keep = np.ones(len(moving), dtype=bool)
    matrix, rmsd = superpose(moving, fixed)
    for _ in range(rounds):
        moved = moving @ matrix[:3, :3].T + matrix[:3, 3]
        near = np.sqrt(((moved - fixed) ** 2).sum(1) / 3) <= far
        if near.sum() < 3 or (near == keep).all():
            break
        keep = near
        matrix, new = superpose(moving[keep], fixed[keep])
        done, rmsd = rmsd - new <= settled, new
        if done:
            break
    return matrix, rmsd


def canonical_orientation(ca: np.ndarray) -> np.ndarray:
    """4x4 rotation about the origin that lays the atom at n/4 on the z axis and the one at 3n/4 in the yz plane."""
    z = ca[len(ca) // 4] / np.linalg.norm(ca[len(ca) // 4])
    other = ca[3 * len(ca) // 4]
    y = other - (other @ z) * z
    y = y / np.linalg.norm(y)
    matrix = np.eye(4)
    matrix[:3, :3] = np.stack([np.cross(y, z), y, z])
    return matrix


def translation(offset) -> np.ndarray:
    matrix = np.eye(4)
    matrix[:3, 3] = offset
    return matrix
