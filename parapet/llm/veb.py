"""Hash trees of one block in van Emde Boas order.

A tree has FAN children a node and is filled from the left: ``n`` leaves, ceil(n / FAN) parents,
and so on up to ``height``, whether or not one node is reached before. It is cut at half its node
levels into an upper tree and the lower trees below it; the upper one is stored first, then the
lower ones from left to right, and each of them is cut and stored in the same way. Missing nodes
take no room: only the last subtree of a row can be smaller than the others, so addresses are
plain arithmetic, and the nodes of a path lie near each other in blocks of any size.
"""

from __future__ import annotations

import hashlib

import numpy as np

FAN, DIGEST = 16, 32


def height_of(n: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def width(n, level: int):
    """Nodes of a level over ``n`` leaves."""
    return -(-n // FAN**level)


def size(n, height: int):
    return sum(width(n, level) for level in range(height + 1))


def address(level: int, index: np.ndarray, n, height: int) -> np.ndarray:
    """Places of the nodes ``index`` of a level (0: leaves) in the layout; ``n`` may differ from tree to tree."""
    index = np.asarray(index, np.int64)
    if height == 0:
        return np.zeros_like(index)
    low = height - (height + 1) // 2
    cut = low + 1
    upper = width(n, cut)
    if level >= cut:
        return address(level - cut, index, upper, height - cut)
    tree = index // FAN ** (low - level)
    leaves = np.minimum(FAN**low, n - tree * FAN**low)
    inside = address(level, index - tree * FAN ** (low - level), leaves, low)
    return size(upper, height - cut) + tree * size(FAN**low, low) + inside


def parent(texts: list[str]) -> bytes:
    return hashlib.sha256("".join(texts).encode()).digest()


def build(leaves: list[bytes], height: int) -> bytes:
    """The layout's digests one after the other; the root comes first."""
    n = len(leaves)
    out = np.empty((size(n, height), DIGEST), np.uint8)
    level = leaves
    for at in range(height + 1):
        out[address(at, np.arange(len(level)), n, height)] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, DIGEST)
        if at < height:
            texts = [x.hex() for x in level]
            level = [parent(texts[i:i + FAN]) for i in range(0, len(texts), FAN)]
    return out.tobytes()


def siblings(nodes: bytes, n: int, height: int) -> list[list[tuple[str, str]]]:
    """Per level below the root, for every node the hex digests of the run before it and after it."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out = []
    for level in range(height):
        count = width(n, level)
        raw = stored[address(level, np.arange(count), n, height)].tobytes().hex()
        pairs, span = [], 2 * DIGEST
        for start in range(0, count, FAN):
            end = min(start + FAN, count)
            pairs += [(raw[start * span:i * span], raw[(i + 1) * span:end * span]) for i in range(start, end)]
        out.append(pairs)
    return out


def leaves_of(nodes: bytes, n: int, height: int) -> list[bytes]:
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    return [x.tobytes() for x in stored[address(0, np.arange(n), n, height)]]


def fold(digest: bytes, path: list[tuple[str, str]]) -> bytes:
    """The root that a leaf gives with its siblings, level by level."""
    for before, after in path:
        digest = parent([before, digest.hex(), after])
    return digest
