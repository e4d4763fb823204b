"""Plain single-process helpers for brute-force comparisons."""


def components(ids, links):
    """id -> smallest id reachable over ``links``."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
