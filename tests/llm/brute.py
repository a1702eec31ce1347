"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import zlib
from collections import Counter

SPACE = b" \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().lower().split()


def held(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def lm_base(docs):
    """doc_id -> (held, n_tokens, n_known, train_tokens, base_score)."""
    tokens = [(i, held(i, 5, 1), [*split(t), b""]) for i, t in docs]
    count = Counter(w for _, out, own in tokens if not out for w in own)
    n, v = sum(count.values()), len(count)
    return [
        (i, out, len(own), sum(w in count for w in own), n,
         sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        for i, out, own in tokens
    ]


def shingle_set(text):
    own = split(text)
    if not own:
        return set()
    if len(own) < 5:
        return {tuple(own)}
    return {tuple(own[k : k + 5]) for k in range(len(own) - 4)}


def jaccard_components(docs):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i)) for i, s in sets)


def line_report(docs, least=1, limit=10):
    def key(line):
        return line.strip(SPACE).lower()

    lines = {i: (t or "").encode().split(b"\n") for i, t in docs}
    often = Counter(k for own in lines.values() for k in {key(x) for x in own})
    out = []
    for i, own in lines.items():
        kept = [x for x in own if len(key(x).decode()) < least or often[key(x)] < limit]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out)


def jaccard_links(docs):
    """(doc_id, n_links) of each row: other distinct sets that its own set is linked with."""
    sets = [(i, frozenset(shingle_set(t))) for i, t in docs]
    distinct = {s for i, s in sets if i is not None and s}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    return sorted(
        (-1 if i is None else i, sum(near(s, o) for o in distinct if o != s) if i is not None and s else 0)
        for i, s in sets
    )
