"""Plain versions of operators, for small tables."""

from __future__ import annotations

from itertools import combinations


def similar(rows, width=3, num=90, den=100):
    """{row number: (shingles, smallest id reachable)} for (id, text), by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        whole = [tuple(words)] if 0 < len(words) < width else zip(*[words[k:] for k in range(width)])
        sets.append(frozenset(whole))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            parent[root(b)] = root(a)
    smallest = {}
    for x, (name, _) in enumerate(rows):
        smallest[root(x)] = min(smallest.get(root(x), name), name)
    return {x: (len(sets[x]), smallest[root(x)]) for x in range(len(rows))}


def deduped(rows, min_chars=10):
    """[(id, kept text, lines, dropped)] for (id, text) with distinct ids."""
    space = " \t\n\x0b\x0c\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(upper)
    first, holders = {}, {}
    for name, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k] = holders.get(k, 0) + 1
                first[k] = min(first.get(k, name), name)
    out = []
    for name, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if holders.get(key(x), 0) < 2 or first[key(x)] == name]
        out.append((name, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out
