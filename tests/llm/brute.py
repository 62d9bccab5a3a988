"""Plain versions of the operators over small tables, in Python."""

import hashlib
from collections import Counter

import xxhash


def words(text):
    return (text or "").encode().split()


def repeats(docs, window=35):
    """{row: (n_words, n_removed, kept text digest)} for a list of texts."""
    lists = [words(t) for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def simhash(text):
    w = words((text or "").encode().lower().decode())
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def near_roots(prints):
    """For each fingerprint a position that stands for its component."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def near_groups(docs):
    """[(doc_id, fingerprint, component_id)] for [(doc_id, text)]."""
    prints = [simhash(t) for _, t in docs]
    roots, least = near_roots(prints), {}
    for r, (d, _) in zip(roots, docs):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(r)) for f, r, (d, _) in zip(prints, roots, docs)]


def bpe(piece, ranks):
    """Ids of one pre-token: the adjacent pair of lowest rank is joined, leftmost first, until no pair is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]
