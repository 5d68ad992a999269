"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(docs: list[tuple]) -> set[tuple]:
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {(i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def topk(vectors: list[tuple], k: int = 10) -> set[tuple]:
    ok = [(i, np.floor(1024 * np.array(v, np.float64))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in ok if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def mix_targets(docs: list[tuple], weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """source -> (size, target) of (doc_id, text, source); reshares the excess step by step."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), share * sum(sizes.values())
    while free:
        level = budget / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = cap * sizes[s]
            budget -= target[s]
        free -= over
    return {s: (sizes[s], target.get(s, level * w[s] if free else cap * sizes[s])) for s in names}


def substrings(docs: list[tuple], window: int = 50) -> set[tuple]:
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first: dict = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = set()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> tuple[int, int, int, str, list[str]]:
    """n_assign, n_access, n_hex, base_sha256, base spans."""
    t = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    listed = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
    n = Counter(s[3] for s in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def components(nodes: dict, radius: int = 4) -> dict:
    """id -> smallest id reachable, of id -> fingerprint."""
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(nodes)
    fps = np.array([nodes[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= radius):
            x, y = sorted((find(i), find(ids[b])))
            root[y] = x
    return {i: find(i) for i in ids}


def tokens(docs: list[tuple], tokenizer, end: int = 2) -> set[tuple]:
    out, start = set(), 0
    for i, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def jaccard(a: str, b: str, size: int = 5) -> float:
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)
