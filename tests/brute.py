"""The comparison spelled out row by row, for small inputs."""

from __future__ import annotations

from collections import defaultdict


def sort_key(value):
    return (value is not None, value)


def close(a, b, tolerance):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float):
        return a == b or abs(a - b) <= tolerance
    return a == b


def classify(source, target, n_keys):
    """Tuples with the key first -> (key, ordinal, source rest, target rest)."""
    groups = defaultdict(lambda: ([], []))
    for side, table in enumerate((source, target)):
        for row in table:
            groups[row[:n_keys]][side].append(row[n_keys:])
    for key, sides in groups.items():
        for side in sides:
            side.sort(key=lambda rest: tuple(sort_key(v) for v in rest))
        for i in range(max(map(len, sides))):
            left, right = (side[i] if i < len(side) else None for side in sides)
            yield key, i + 1, left, right


def summary(source, target, n_keys, tolerance=0.0001):
    counts = dict.fromkeys(("source_only", "target_only", "matched", "all_equal"), 0)
    matches = defaultdict(int)
    for _, _, left, right in classify(source, target, n_keys):
        if right is None:
            counts["source_only"] += 1
        elif left is None:
            counts["target_only"] += 1
        else:
            counts["matched"] += 1
            flags = [close(a, b, tolerance) for a, b in zip(left, right)]
            counts["all_equal"] += all(flags)
            for i, flag in enumerate(flags):
                matches[i] += flag
    return counts, dict(matches)
