"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's segmentations into pieces form a lattice, each weighted by the product of its pieces' weights. Forward
filtering sums the weights of all paths into each position; backward sampling walks from the end, drawing each
piece with its exact posterior. Draws come from a counter-based generator keyed by (seed, row key, word
number, step), so the same row gives the same pieces on any cluster and after any retry.

The vocabulary has no usable piece that goes on past a space, so the lattice falls apart at spaces and filtering
is done once for each distinct word of a batch; every occurrence is then sampled on its own. All steps are
numpy over a batch. Unigram models bring log probabilities; merge-ranked (BPE) models get Zipf weights
-log(rank + 2). `alpha` sharpens (large) or flattens (small) the distribution; alpha = inf takes the best path.

Losslessness: a character without a piece, and a literal U+2581, are spelt in byte pieces. Decoding joins
pieces, turns word marks to spaces and drops the one that encoding put first.

Defined cases: null counts as empty, and an empty text has no pieces; rows alike in key and text get the same
pieces; a null key is a key of its own; extra columns are kept by `encode`; texts of any length and without
any space are sampled whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.llm.common import slices

MARK = "▁"
#: Stands for a literal word mark while a text is cut up; no valid text holds a lone surrogate.
_LITERAL = 0xD800
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
#: Bits of a key that say whether a piece may have it, before the keys themselves are searched.
_FILTER = 20
#: Characters whose lattices are built together.
CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vocabulary(path: str) -> dict:
    """What encoding and decoding need of a model file: usable pieces, their log weights, byte pieces, and bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = [model.get_score(i) for i in range(n)]
    usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and (scores[i] > -1e8 or len(pieces[i]) == 1) and MARK not in pieces[i][1:]]
    ranked = all(float(scores[i]).is_integer() for i in usable)
    lowest = min((scores[i] for i in usable if scores[i] > -1e8), default=0.0)
    weights = [-np.log(2.0 - max(scores[i], lowest)) if ranked else max(scores[i], lowest) for i in usable]
    spelt = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    if len(spelt) != 256:
        raise ValueError("the model has no byte pieces")
    return {"pieces": [pieces[i] for i in usable], "ids": usable, "weights": weights, "bytes": [spelt[b] for b in range(256)], "raw": raw}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(int(_BASE), -1, 2**64), np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _scattered(codes: np.ndarray) -> np.ndarray:
    return _mix((codes.astype(np.uint64) + np.uint64(1)) * _GOLDEN)


class Sampler:
    """Samples texts' pieces from a vocabulary."""

    def __init__(self, vocabulary: dict, alpha: float = 1.0, seed: int = 0):
        self.v, self.alpha, self.seed = vocabulary, alpha, np.uint64(seed % 2**64)
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in vocabulary["pieces"]]
        up = _powers(max(map(len, codes)) + 1)[0]
        keys = np.array([int((_scattered(c) * up[: len(c)]).sum(dtype=np.uint64)) for c in codes], np.uint64)
        lengths = np.array([len(c) for c in codes])
        self.by_length = {}
        for n in np.unique(lengths)[::-1]:
            at = np.flatnonzero(lengths == n)
            at = at[np.argsort(keys[at])]
            likely = np.zeros(1 << _FILTER, bool)
            likely[keys[at] >> np.uint64(64 - _FILTER)] = True
            self.by_length[int(n)] = (keys[at], at.astype(np.int32), likely)
        self.weights = np.array(vocabulary["weights"], np.float64) * (1.0 if np.isinf(alpha) else alpha)
        self.least = self.weights.min(initial=0.0) - 5.0
        self.ids = np.array(vocabulary["ids"], np.int32)

    def lattice(self, words: list[str]) -> tuple:
        """Edges of all words' lattices, sorted by end node, long pieces first: (end, start, piece or -1, cumulative posterior in units of 2^-32, code), and each word's first and last node."""
        parts, node, n = [], 0, 0
        for stop in self._chunks(words):
            starts, ends, piece, share, code, first, last = self._lattice(words[n:stop])
            parts.append((starts + node, ends + node, piece, share, code, first + node, last + node))
            node, n = node + int(last[-1]) + 1, stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _chunks(self, words: list[str]) -> Iterator[int]:
        """Ends of runs of words of about CHUNK characters: what a lattice needs while it is built follows them."""
        held = 0
        for i, w in enumerate(words, 1):
            held += len(w)
            if held >= CHUNK or i == len(words):
                yield i
                held = 0

    def _lattice(self, words: list[str]) -> tuple:
        joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes)
        first = stops - sizes + np.arange(len(words))  # nodes: one more than characters in each word
        last = first + sizes
        node = (np.arange(len(joined)) + np.repeat(np.arange(len(words)), sizes)).astype(np.int32)
        room = (np.repeat(stops, sizes) - np.arange(len(joined))).astype(np.int32)
        up, down = _powers(len(joined))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_scattered(joined) * up)])
        starts, ends, piece = [], [], []
        single = np.zeros(len(joined), bool)
        for n, (keys, at, likely) in self.by_length.items():
            m = max(0, len(joined) - n + 1)
            key = (sums[n:] - sums[:m]) * down[:m]
            where = np.flatnonzero(likely[key >> np.uint64(64 - _FILTER)] & (room[:m] >= n))
            key = key[where]
            hit = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[hit] == key
            where = where[ok]
            if n == 1:
                single[where] = True
            starts.append(node[where])
            ends.append(starts[-1] + n)
            piece.append(at[hit[ok]])
        odd = np.flatnonzero(~single)
        starts, ends, piece = np.concatenate([*starts, node[odd]]), np.concatenate([*ends, node[odd] + 1]), np.concatenate([*piece, np.full(len(odd), -1, np.int32)])
        code = np.zeros(len(starts), np.uint32)
        code[len(starts) - len(odd) :] = joined[odd]
        order = np.argsort(ends, kind="stable")  # a merge of one run for each length
        starts, ends, piece, code = (x[order] for x in (starts, ends, piece, code))
        cut = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, int)
        p = self._posterior(starts, ends, piece, cut, first, last)
        degree = np.diff(np.append(cut, len(ends)))
        for rank in range(1, int(degree.max(initial=1))):
            at = cut[degree > rank] + rank
            p[at] += p[at - 1]
        return starts, ends, piece, np.minimum(p * 2.0**32, 2.0**32).astype(np.int64), code, first, last

    def _posterior(self, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray, cut: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Forward filtering: the share of each edge among the weights of all paths into its end node; nodes of one depth at a time."""
        weight = np.where(piece >= 0, self.weights[piece], self.least)
        log = np.full(int(last[-1]) + 1 if len(last) else 1, -np.inf)
        log[first] = 0.0
        depth = np.arange(len(log)) - np.repeat(first, last - first + 1)
        deep = depth[ends[cut]]
        order = np.argsort(deep.astype(np.uint16) if deep.max(initial=0) < 1 << 16 else deep, kind="stable")
        size = np.diff(np.append(cut, len(ends)))[order]
        stop = np.cumsum(size)
        edge = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(cut[order], size)
        starts, weight, group = starts[edge], weight[edge], stop - size  # edges by depth of their end, each node's together
        value = np.empty(len(edge))
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(deep[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
        goal = ends[cut][order]
        for g, h in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = group[g], stop[h - 1]
            v = log[starts[a:b]] + weight[a:b]
            value[a:b] = v
            at = group[g:h] - a
            top = np.maximum.reduceat(v, at)
            log[goal[g:h]] = top if np.isinf(self.alpha) else top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size[g:h])), at))
        total = np.repeat(log[goal], size)
        p = np.empty(len(edge))
        p[edge] = (value >= total).astype(float) if np.isinf(self.alpha) else np.exp(value - total)
        return p

    def texts(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids end to end, and where each text's end; keys are the rows' 64-bit keys."""
        column = pa.array([t.replace(MARK, "\x00") if t and MARK in t else t or "" for t in texts])
        parts = pc.split_pattern(column, " ")
        marked = {i for i, t in enumerate(texts) if t and MARK in t}
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        counts[[i for i, t in enumerate(texts) if not t]] = 0
        flat = pc.list_flatten(pa.ListArray.from_arrays(parts.offsets, parts.values).filter(pa.array(counts > 0))).dictionary_encode()
        names = flat.dictionary.to_pylist()
        codes = np.asarray(flat.indices).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        words = [MARK + w for w in names]
        if marked:
            codes, words = self._literal(texts, counts, codes, words)
        if not words or not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts, ends, piece, share, code, first, last = self.lattice(words)
        begin = np.searchsorted(ends, np.arange(int(last[-1]) + 2))
        row = np.repeat(np.arange(len(texts)), counts)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        stream = _mix(_mix(np.array(keys, np.uint64)[row] ^ self.seed) + inside.astype(np.uint64) * _GOLDEN)
        at, goal, who = last[codes], first[codes], np.arange(len(codes))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            stream = stream + _GOLDEN
            drawn = (_mix(stream) >> np.uint64(32)).astype(np.int64)
            low, top = begin[at], begin[at + 1] - 1
            edge, open_ = low, np.flatnonzero(low < top)
            while len(open_):  # long pieces come first, so that few edges are looked at
                open_ = open_[share[edge[open_]] <= drawn[open_]]
                edge[open_] += 1
                open_ = open_[edge[open_] < top[open_]]
            steps.append((who, edge))
            at = starts[edge]
            more = at > goal
            at, goal, who, stream = at[more], goal[more], who[more], stream[more]
        taken = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(codes))
        end = np.cumsum(taken)
        path = np.empty(int(end[-1]), np.int64)
        for k, (w, edge) in enumerate(steps):
            path[end[w] - 1 - k] = edge
        return self._ids(path, piece, code, np.concatenate([[0], end])[np.cumsum(counts)])

    def _literal(self, texts: list, counts: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Words of the texts that hold a literal word mark, cut again so that it can be told from others."""
        known: dict[str, int] = {w: i for i, w in enumerate(words)}
        ends = np.cumsum(counts)
        codes = codes.copy()
        for i, t in enumerate(texts):
            if t and MARK in t:
                for k, w in enumerate(t.replace(MARK, chr(_LITERAL)).split(" ")):
                    codes[ends[i] - counts[i] + k] = known.setdefault(MARK + w, len(known))
        return codes, list(known)

    def _ids(self, path: np.ndarray, piece: np.ndarray, code: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path of edges; characters without a piece become their bytes'."""
        chosen = piece[path]
        odd = np.flatnonzero(chosen < 0)
        ids = self.ids[chosen]
        if not len(odd):
            return ids, stops
        spelt = {int(c): [self.v["bytes"][b] for b in (MARK if c == _LITERAL else chr(int(c))).encode()] for c in np.unique(code[path[odd]])}
        width = np.ones(len(path), np.int64)
        width[odd] = [len(spelt[int(c)]) for c in code[path[odd]]]
        end = np.concatenate([[0], np.cumsum(width)])
        out = np.empty(int(end[-1]), np.int32)
        out[end[:-1]] = ids
        for i, c in zip(odd.tolist(), code[path[odd]].tolist(), strict=True):
            out[end[i] : end[i + 1]] = spelt[c]
        return out, end[stops]


class Decoder:
    """Texts of piece ids."""

    def __init__(self, vocabulary: dict):
        self.pool = np.frombuffer(b"".join(vocabulary["raw"]), np.uint8)
        self.sizes = np.fromiter(map(len, vocabulary["raw"]), np.int64, len(vocabulary["raw"]))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def text(self, ids: np.ndarray) -> bytes:
        """UTF-8 of one text."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) - np.repeat(ends - n - self.starts[ids], n)].tobytes()[1:] if total else b""


def row_key(value: int | str | None) -> int:
    """A row's 64-bit key."""
    return int(value) % 2**64 if isinstance(value, int) else int.from_bytes(hashlib.sha256(repr(value).encode()).digest()[:8], "little")


def encode(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """docs' columns but text, with pieces array<int>, n_pieces, ids_crc32, decoded_sha256 (of the text that decoding gives back), lossless."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rest = [c for c in docs.columns if c != "text"]
    names = ["pieces", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + ["pieces array<int>, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decoder = Sampler(shipped.value, alpha, seed), Decoder(shipped.value)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            ids, stops = sampler.texts(texts, [row_key(k) for k in batch.column(key).to_pylist()])
            offsets = np.concatenate([[0], stops])
            crc, sha, same = [], [], []
            for t, a, b in zip(texts, offsets, stops, strict=False):
                own = ids[a:b]
                raw = decoder.text(own)
                crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                sha.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == (t or "").encode())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists, pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=[*rest, *names])

    return docs.select(*rest, "text").mapInArrow(run, schema)
