"""SentencePiece encoding and decoding with N-best segmentation.

A text's segmentations into the pieces of a model file form a lattice, scored by the sum of the
pieces' scores in that file. Forward Viterbi gives the best score from the start to every
position. An A-star search runs backward from the end: what it has gathered so far plus the
Viterbi score of the position it has reached is exactly the best score of any completion, so paths come
out in the order of their scores, N of them for N results.

No piece of the model has a space mark after another character (this is checked when it is
loaded), so the lattice falls apart before each run of spaces into segments. The new segments of many texts are
searched together: their edges are found by walking a trie from all positions at once, one sweep over the end positions is
the Viterbi pass of all, and one sweep back follows the best paths. What A-star's queue holds when a best path is complete
are the edges that join it from elsewhere, each at its exact score, so the highest of them is the second best.
A result is kept in a cache of so many segments. The N best of a whole text differ from the best in the N - 1 segments, at most,
whose second-best is nearest; only those are searched for N results, and merged exactly. As every estimate is exact, the queue never
needs more than N entries. Segments of over 100 characters are cut where no piece joins two neighbours, and are not cached.

The only vocabulary file here is of the BPE kind, whose scores are merge ranks. The best lattice path
minimises the sum of ranks and need not be what BPE merging gives; decoding is exact for either.

Defined results: spaces become the mark, one is put before the text, and a mark in a text reads as a
space; a character without a piece falls back to its bytes, at the score of the lowest piece less 10; null and
empty texts have no pieces and score 0; equal scores come in an order fixed by the search;
with fewer than N segmentations there are fewer results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import table
from lodestrata.llm.shingles import slices

MARK = "▁"
CACHED = 700_000
#: Longer segments are cut and searched each time.
LONGEST_CACHED = 100
#: So many characters of new segments are searched together.
AT_ONCE = 50_000
_RUNS = re.compile(r" *[^ ]+| +\Z", re.S)
_models: dict[str, PieceModel] = {}


class Solved(NamedTuple):
    """Results of many segments: of segment i the ids ids[cut[i]:cut[i + 1]] of the best, its score, how much lower the second is."""

    ids: np.ndarray
    cut: np.ndarray
    score: np.ndarray
    gap: np.ndarray

    @staticmethod
    def joined(parts: list[Solved]) -> Solved:
        size = np.concatenate([np.diff(p.cut) for p in parts])
        return Solved(np.concatenate([p.ids for p in parts]), np.concatenate([[0], np.cumsum(size)]), np.concatenate([p.score for p in parts]), np.concatenate([p.gap for p in parts]))

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments at these places, how many each has)."""
        size = np.diff(self.cut)[at]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.cut[at] - before, size) + np.arange(size.sum())], size


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of, self.byte_of, self.bytes_id, self.score = {}, {}, {}, {}
        self.id_of: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:-1], 16)
                self.bytes_id[self.byte_of[i]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece], self.text_of[i], self.score[i] = i, piece, sp.get_score(i)
        self.pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.unknown = min(self.score.values()) - 10
        top = max([*self.text_of, *self.byte_of]) + 1
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text_of.get(i, "").replace(MARK, " ").encode() for i in range(top)]
        self.spelt, self.spelt_at = np.frombuffer(b"".join(spelt), dtype=np.uint8), np.cumsum([0, *map(len, spelt)])
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self._build_trie()
        self._forget()
        self.nbest = lru_cache(maxsize=50_000)(self._nbest)

    def _build_trie(self) -> None:
        """Nodes are numbers; the children of all are one sorted array of node * n_codes + code."""
        chars = sorted({c for p in self.id_of for c in p})
        self.code_of = np.zeros(0x110000, dtype=np.int64)  # 0: in no piece
        self.code_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_codes = len(chars) + 1
        codes, children, piece = dict(zip(chars, range(1, len(chars) + 1))), {}, [-1]
        for p, i in self.id_of.items():
            node = 0
            for c in p:
                key = node * self.n_codes + codes[c]
                node = children.setdefault(key, len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        keys = np.array(list(children), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), dtype=np.int64)[order]
        self._children, self._piece_list = children, piece
        self.piece_of = np.array(piece, dtype=np.int64)
        self.node_score = np.array([self.score.get(i, 0.0) for i in piece])
        self.first = np.full(self.n_codes, -1, dtype=np.int64)
        tops = self.keys < self.n_codes
        self.first[self.keys[tops]] = self.child[tops]

    def _forget(self) -> None:
        #: segment -> its place in the arrays; ids of all segments are one array
        self.cache: dict[str, int] = {}
        self.known = Solved(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0), np.empty(0))

    def _edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, score, piece or -1 for a character's bytes) of every edge; from each start no edge passes its stop."""
        at, node = np.arange(len(codes)), self.first[codes]
        lone = np.flatnonzero((node < 0) | (self.piece_of[node] < 0))
        found = [(lone, np.ones(len(lone), dtype=np.int64), np.full(len(lone), self.unknown), np.full(len(lone), -1))]
        at, node, length = at[node >= 0], node[node >= 0], 1
        while len(at):
            piece = self.piece_of[node]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), self.node_score[node[hit]], piece[hit]))
            more = at + length < stop[at]
            at, node = at[more], node[more]
            key = node * self.n_codes + codes[at + length]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            at, node, length = at[ok], self.child[place[ok]], length + 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_id[b] for b in char.encode("utf-8", "surrogatepass"))

    def segments(self, text: str) -> list[str]:
        """The segments without their first mark, with spaces as marks: every segment begins with one."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.cuts:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in _RUNS.findall(" " + text)]
        return text.split(" ")

    def _solve(self, segs: list[str]) -> Solved:
        """Segments or parts of them, marks as they stand."""
        text, lens = "".join(segs), np.array([len(s) for s in segs])
        codes = self.code_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        ends = np.cumsum(lens)
        owner = np.repeat(np.arange(len(segs)), lens)
        at, length, score, piece = self._edges(codes, ends[owner])
        # a segment of n characters has n + 1 positions
        origin, start = ends - lens + np.arange(len(segs)), at + owner[at]
        end = start + length
        order = np.argsort((end - origin[owner[at]]).astype(np.int16), kind="stable")
        start, end, score, piece = start[order], end[order], score[order], piece[order]
        rel = np.searchsorted(end - origin[owner[at[order]]], np.arange(1, lens.max() + 2))
        best = np.full(len(text) + len(segs), -np.inf)
        best[origin] = 0.0
        for a, z in zip(rel, rel[1:]):
            np.maximum.at(best, end[a:z], best[start[a:z]] + score[a:z])
        lost = best[end] - (best[start] + score)
        back = np.full(len(best), len(best))
        on_best = lost == 0
        np.minimum.at(back, end[on_best], start[on_best])  # of equal ones that from the nearest to the start
        passed, z, low = np.zeros(len(best), dtype=bool), origin + lens, origin
        while len(z):
            passed[z] = True
            z = back[z]
            z, low = z[z > low], low[z > low]
        chosen = back[end] == start
        gap = np.full(len(segs), np.inf)
        other = passed[end] & ~chosen
        of = np.repeat(np.arange(len(segs)), lens + 1)
        np.minimum.at(gap, of[end[other]], lost[other])
        piece_at = np.full(len(best), -1)
        piece_at[end[chosen]] = piece[chosen]
        path = np.flatnonzero(passed)
        ids, n = piece_at[path], np.ones(len(path), dtype=np.int64)
        lone = np.flatnonzero(ids < 0)
        raw = [self._bytes(text[i]) for i in (path[lone] - of[path[lone]] - 1).tolist()]
        n[lone] = [len(r) for r in raw]
        flat = np.repeat(ids, n).astype(np.int32)
        for k, r in zip((np.cumsum(n) - n)[lone].tolist(), raw):
            flat[k : k + len(r)] = r
        cut = np.concatenate([[0], np.cumsum(np.bincount(of[path], weights=n, minlength=len(segs)).astype(np.int64))])
        return Solved(flat, cut, best[origin + lens], gap)

    def _lattice(self, seg: str):
        """Of one long segment: (edges into each position as a function, the best score from the start to each position)."""
        codes = self.code_of[np.frombuffer(seg.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        start, length, score, piece = self._edges(codes, np.full(len(seg), len(seg)))
        order = np.argsort(start + length, kind="stable")
        start, score, piece, end = start[order], score[order], piece[order], (start + length)[order]
        cut = np.searchsorted(end, np.arange(len(seg) + 2))
        best = np.full(len(seg) + 1, -np.inf)
        best[0] = 0.0
        for z in range(1, len(seg) + 1):
            a, b = cut[z], cut[z + 1]
            best[z] = (best[start[a:b]] + score[a:b]).max()

        def into(z):
            a, b = cut[z], cut[z + 1]
            return [(x, s, (p,) if p >= 0 else self._bytes(seg[z - 1])) for x, s, p in zip(start[a:b].tolist(), score[a:b].tolist(), piece[a:b].tolist())]

        return into, best

    def _short_lattice(self, seg: str):
        """The same of a short one, where a loop costs less than arrays."""
        n, keys, child = len(seg), self._children, self.n_codes
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        codes = self.code_of[[ord(c) for c in seg]].tolist()
        for a in range(n):
            here, node = best[a], 0
            for z in range(a + 1, n + 1):
                node = keys.get(node * child + codes[z - 1])
                if node is None:
                    break
                piece = self._piece_list[node]
                if piece >= 0:
                    s = self.score[piece]
                    into[z].append((a, s, (piece,)))
                    if here + s > best[z]:
                        best[z] = here + s
            if seg[a] not in self.id_of:
                into[a + 1].append((a, self.unknown, self._bytes(seg[a])))
                best[a + 1] = max(best[a + 1], here + self.unknown)
        return into.__getitem__, best

    def _nbest(self, seg: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Backward A-star search: the n best (score, ids) of a segment, marks as they stand."""
        into, best = (self._short_lattice if len(seg) <= LONGEST_CACHED else self._lattice)(seg)
        # of equal estimates the one nearest to the start goes on, so ties do not widen the search
        heap: list[tuple] = [(-best[len(seg)], len(seg), 0, None, 0.0)]
        out: list[tuple[float, tuple[int, ...]]] = []
        pushed = 0
        while heap and len(out) < n:
            _, at, _, path, gathered = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((gathered, tuple(ids)))
                continue
            for a, s, got in into(at):
                pushed += 1
                heapq.heappush(heap, (-(gathered + s + best[a]), a, pushed, (got, path), gathered + s))
            if len(heap) > 64 * n:
                heap = heapq.nsmallest(n, heap)  # each entry stands for a whole path of exactly its estimate
        return out

    def _solve_long(self, seg: str) -> Solved:
        """One long segment, by the parts between pairs that no piece spans."""
        cuts = [0, *[k for k in range(1, len(seg)) if seg[k - 1 : k + 1] not in self.pairs], len(seg)]
        parts = [seg[a:z] for a, z in zip(cuts, cuts[1:])]
        different = list(dict.fromkeys(parts))
        found = self._solve_all([p for p in different if len(p) <= LONGEST_CACHED])
        place = {p: i for i, p in enumerate(p for p in different if len(p) <= LONGEST_CACHED)}
        for p in different:
            if len(p) > LONGEST_CACHED:
                two = self._nbest(p, 2)
                gap = two[0][0] - two[1][0] if len(two) > 1 else np.inf
                one = Solved(np.array(two[0][1], dtype=np.int32), np.array([0, len(two[0][1])]), np.array([two[0][0]]), np.array([gap]))
                place[p] = len(found.score)
                found = Solved.joined([found, one])
        at = np.array([place[p] for p in parts])
        ids, _ = found.ids_of(at)
        return Solved(ids, np.array([0, len(ids)]), found.score[at].sum(keepdims=True), found.gap[at].min(keepdims=True))

    def _solve_all(self, segs: list[str]) -> Solved:
        """Segments of up to LONGEST_CACHED characters, some thousand at once; those of like length together."""
        found, at = [Solved(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0), np.empty(0))], 0
        while at < len(segs):
            to = at + max(1, AT_ONCE // len(segs[at]))
            found.append(self._solve(segs[at:to]))
            at = to
        return Solved.joined(found)

    def _learn(self, keys: list[str]) -> None:
        """Searches segments and puts them into the cache."""
        keys.sort(key=len)
        short = [k for k in keys if len(k) < LONGEST_CACHED]
        found = [self.known, self._solve_all([MARK + k.replace(" ", MARK) for k in short])]
        long = keys[len(short) :]
        found += [self._solve_long(MARK + k.replace(" ", MARK)) for k in long]
        self.cache.update(zip([*short, *long], range(len(self.known.score), len(self.known.score) + len(keys))))
        self.known = Solved.joined(found)

    def encode_all(self, texts: list[str | None], n: int = 1) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int]]]]]]:
        """For each text: ids of the best segmentation; for the n best their score and the (segment, alternative) pairs in which they differ from the best."""
        cut = [self.segments(t or "") for t in texts]
        if len(self.cache) > CACHED:
            self._forget()
        cache = self.cache
        starts = np.concatenate([[0], np.cumsum([len(s) for s in cut])]).astype(np.int64)
        places = np.concatenate([np.empty(0), *[np.array(list(map(cache.get, segs)), dtype=np.float64) for segs in cut]])  # NaN where there is none
        missing = np.flatnonzero(np.isnan(places))
        of = np.searchsorted(starts, missing, side="right") - 1
        absent = [cut[i][k] for i, k in zip(of.tolist(), (missing - starts[of]).tolist())]
        new = list(set(absent))
        if new:
            self._learn(new)
            places[missing] = [cache[s] for s in absent]
        at = places.astype(np.int64)
        ids, size = self.known.ids_of(at)
        upto = np.concatenate([[0], np.cumsum(size)])[starts]
        score, gaps = self.known.score[at], self.known.gap[at]
        out = []
        for i, segs in enumerate(cut):
            a, z = starts[i], starts[i + 1]
            found: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
            if n > 1 and segs:
                for k in np.argpartition(gaps[a:z], n - 2)[: n - 1].tolist() if z - a >= n else range(z - a):
                    if gaps[a + k] == np.inf:
                        continue
                    ways = self._ways(segs[k], n)
                    more = [(d + ways[0][0] - ways[j][0], [*c, (k, j)] if j else c) for d, c in found for j in range(len(ways))]
                    found = sorted(more, key=lambda x: x[0])[:n]
            total = float(score[a:z].sum())
            out.append((ids[upto[i] : upto[i + 1]], [(total - d, c) for d, c in found]))
        for s in new:
            if len(s) >= LONGEST_CACHED:
                del cache[s]
        return out

    def _ways(self, key: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        seg = MARK + key.replace(" ", MARK)
        return self.nbest(seg, n) if len(seg) <= LONGEST_CACHED else self._nbest(seg, n)

    def encode(self, text: str | None, n: int = 1) -> tuple[bytes, list[tuple[float, list[tuple[int, int]]]]]:
        ids, found = self.encode_all([text], n)[0]
        return ids.tobytes(), found

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: score, ids."""
        segs = self.segments(text)
        out = []
        for score, changes in self.encode(text, n)[1]:
            which = dict(changes)
            out.append((score, [i for k, s in enumerate(segs) for i in self._ways(s, n)[which.get(k, 0)][1]]))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        size = np.diff(self.spelt_at)[ids]
        before = np.cumsum(size) - size
        raw = self.spelt[np.repeat(self.spelt_at[ids] - before, size) + np.arange(size.sum())].tobytes()
        return raw.decode("utf-8", "surrogatepass").removeprefix(" ")


def piece_model(path: str) -> PieceModel:
    """One for each process and model file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


ADDED = "n_pieces long, score double, nbest_scores array<double>, exact boolean"


def encode_pieces(docs: DataFrame, path: str, n: int = 4, digest: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, n_pieces, score, the scores of the n best, whether the best one's ids decode to the text, and
    those ids, or with ``digest`` only their CRC-32 as little-endian 32-bit integers (ids_crc32)."""
    last = "ids_crc32" if digest else "ids"
    kept = [c for c in docs.columns if c not in ("text", "n_pieces", "score", "nbest_scores", "exact", last)]
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches):
        model = piece_model(path)
        for whole in batches:
            at = 0
            for some in slices(whole.column(whole.num_columns - 1)):
                batch, texts = whole.slice(at, len(some)), some.to_pylist()
                at += len(some)
                got = model.encode_all(texts, n)
                ids = [x for x, _ in got]
                exact = [model.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                sizes = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                out = pa.array([zlib.crc32(x.astype("<i4")) for x in ids], pa.int64()) if digest else pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids)))
                more = [pa.array(np.diff(sizes).astype(np.int64)), pa.array([x[0][0] for _, x in got], pa.float64()), pa.array([[s for s, _ in x] for _, x in got], pa.list_(pa.float64())), pa.array(exact), out]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*kept, "n_pieces", "score", "nbest_scores", "exact", last])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    added = f"{ADDED}, ids_crc32 long" if digest else f"{ADDED}, ids array<int>"
    return rows.mapInArrow(encode, f"{shape}, {added}" if shape else added)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score, nbest_scores, exact, ids_crc32."""
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), digest=True)
