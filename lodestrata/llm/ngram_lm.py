"""Language-model scoring with a memory-mapped n-gram trie.

Words (A-Z lowered) are known by a 64-bit hash; two that collide share a count, with a chance of
n**2 / 2**65 among n words. Every level is a run of segment files in the shared folder:

* level 1: the sorted hashes of all training words in Elias-Fano form, and their counts. A word's id
  is its rank. The end of a text has an id of its own and is also the context of its first word.
* levels 2 and 3: for the contexts of a segment the children's ids, sorted within each context and each raised by its
  context's base, which is the last number of the context before, so that all of them ascend; pointers
  to each context's first child; both monotone sequences in Elias-Fano form; 16-bit codes of the
  discounted probability of each child and of the mass that each context leaves to shorter ones.

A level's directory is a file too, of some 150 bytes for a segment of a million tokens: one task writes it from narrow rows, the others map it, and
only its path passes the driver. Tasks keep the last 256 segments of a level mapped, each by one mapping and no open descriptor.

p(w | uv) = a(uvw) + g(uv) p(w | v), p(w | v) = a(vw) + g(v) p(w), p(w) = (c + 1) / (N + V + 1), with
a = (c - D(c)) / c(context) for every n-gram that was seen, else 0, and g = 1 - the sum of a. So the
probabilities of all V + 1 words (one for all unknown) sum to 1 after any context, but for the codes, which
divide a decade by 4096. A level has three discounts D, for counts of one, two, and more, estimated from how many of all
its n-grams were seen once to four times (modified absolute discounting); where some of those numbers are 0, D is 0.75.
No n-gram is left out; ``least_count`` above 1 drops rarer ones, for a smaller model.

A child is found by a successor search for its id plus its context's base, within its context's range. Counting: tasks sum sorted
keys (context, word) of some million tokens, cut them at bounds that split all keys evenly, so
that a frequent context is cut too; one task for each cut adds them up, and when the discounts are known writes a segment. A trigram is counted only
if both its bigrams were kept. Bounds come from a bounded sample of
different documents (4,000 at most, some 200 keys for each); every key is counted.

Segments are mapped, not loaded: from the shared folder where that is a path of the machine, else from a copy that the first
process of a machine makes.

Defined results: a null text has no words, only the end; a null doc_id belongs to the training rows;
repeated rows count each; without training rows every score is 0; an empty table gives an empty result. A trigram's key is the rank of its first bigram times
the number of words plus a word, in 64 bits: a corpus whose distinct bigrams times distinct words reach 2**63 (a billion by nine billion) ends with an error.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.arrays import drop_folder, reader, write_arrays
from lodestrata.llm.common import new_path, settle, table
from lodestrata.llm.shingles import slices, word_hashes

DISCOUNT = 0.75
CODES_A_DECADE = 4096
TOKENS_AT_ONCE, IDS_AT_ONCE = 1_000_000, 500_000
SAMPLE_DOCS, SAMPLE_KEYS = 2000, 200
MOST_OPEN = 256
#: The least position of the k-th set bit of a byte.
_BIT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], dtype=np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- Elias-Fano


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(values) * width + 63) // 64 + 1, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (shift > 0) & (shift + np.uint64(width) > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A sorted sequence of n numbers below 2**64: their low bits packed, their high bits as a unary bit vector with a sum of ones for each 512 bits.

    Sums before each word of 64 bits, by which ``select`` searches, are made in memory when first asked for: 8 bytes a word and kind of bit.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.sums = {}  # of the bits of a kind before each word, made when first asked for

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        top = (v >> np.uint64(width)).astype(np.int64)
        size = n + (universe >> width) + 2
        bits = np.zeros(-(-size // 512) * 512 + 512, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        blocks = np.bitwise_count(high).astype(np.int64).reshape(-1, 8).sum(1)
        return cls(n, width, pack_bits(v & np.uint64((1 << width) - 1), width), high, np.concatenate([[0], np.cumsum(blocks)[:-1]]))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.width], dtype=np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def read(cls, load, prefix: str) -> EliasFano:
        n, width = (int(x) for x in load(f"{prefix}head"))
        return cls(n, width, load(f"{prefix}low"), load(f"{prefix}high"), np.asarray(load(f"{prefix}ones")))

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) bit of that kind."""
        if bit not in self.sums:
            ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64) - np.bitwise_count(self.high)
            self.sums[bit] = ones if bit else np.arange(len(ones), dtype=np.int64) * 64 - ones
        at = np.searchsorted(self.sums[bit], k, side="right") - 1
        left = k - self.sums[bit][at]
        word = self.high[at] if bit else ~self.high[at]
        place = at * 64
        for width in (32, 16, 8):  # the half that has it, down to a byte
            below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            above = left >= below
            left -= below * above
            word >>= above * np.uint64(width)
            place += above * width
        return place + _BIT[(word & np.uint64(255)).astype(np.int64), left]

    def run(self, at: np.ndarray, bit: int) -> np.ndarray:
        """How many bits of that kind stand from a position on, up to the next of the other kind; 64 or more are given as 64."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        more = np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        window = (self.high[word] >> shift) | more
        other = ~window if bit else window
        return np.bitwise_count(~other & (other - np.uint64(1))).astype(np.int64)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | more) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        top = (self.select(i, 1) - i).astype(np.uint64)
        return (top << np.uint64(self.width)) | self.low_bits(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ranks i and i + 1."""
        at = self.select(i, 1)
        gap = self.run(at + 1, 0)
        after = at + 1 + gap
        far = np.flatnonzero(gap >= 64)
        after[far] = self.select(i[far] + 1, 1)
        both = [((x - r).astype(np.uint64) << np.uint64(self.width)) | self.low_bits(r) for x, r in ((at, i), (after, i + 1))]
        return both[0], both[1]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each x, -1 where it is not in the sequence."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        place = np.where(top > 0, self.select(np.maximum(top - 1, 0), 0) + 1, 0)
        start = place - top
        size = self.run(place, 1)
        end = start + size
        far = np.flatnonzero(size >= 64)
        end[far] = self.select(top[far], 0) - top[far]
        want = x & np.uint64((1 << self.width) - 1)
        lo, hi = start, end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_bits(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = lo < end
        hit[hit] = self.low_bits(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)


# ---------------------------------------------------------------- segment files


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-15)) * CODES_A_DECADE), 0, 65535).astype(np.uint16)


def decode(c: np.ndarray) -> np.ndarray:
    return 10.0 ** (-c.astype(np.float64) / CODES_A_DECADE)


class Segments:
    """The segments of a level by its directory, ascending; ``opened`` makes of a segment's arrays what is kept of the last ``MOST_OPEN`` ones."""

    def __init__(self, directory: str | None, opened):
        self.column = reader(directory) if directory else lambda name: np.empty(0, dtype=np.int64)
        self.paths, self.first, self.size = self.column("path"), self.column("first"), self.column("n")
        self.opened, self.held = opened, OrderedDict()

    def __len__(self):
        return len(self.paths)

    def __getitem__(self, i: int):
        if i not in self.held:
            self.held[i] = self.opened(reader(self.paths[i].decode()))
            if len(self.held) > MOST_OPEN:
                self.held.popitem(last=False)
        self.held.move_to_end(i)
        return self.held[i]

    def ranges(self, ranks: np.ndarray):
        """(segment, places) of sorted ranks: each segment that holds some of them."""
        of = np.searchsorted(self.first, ranks, side="right") - 1
        for i in np.unique(of[of >= 0]):
            a, z = np.searchsorted(of, [i, i + 1])
            yield int(i), slice(a, z)


def _directory(found: DataFrame, folder: str) -> tuple[str | None, int]:
    """Writes what the rows of ``found`` (part, path, n, numbers) say of a level's segments, by ascending part. (path, sum of n)."""
    numbers = [c for c in found.columns if c not in ("path", "n")]

    def write(batches):
        rows = [pdf for pdf in batches if len(pdf)]
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            n = rows["n"].to_numpy()
            arrays = {c: rows[c].to_numpy() for c in numbers} | {"n": n, "first": np.cumsum(n) - n, "path": np.array([x.encode() for x in rows["path"]])}
            yield pd.DataFrame({"path": [write_arrays(folder, arrays)], "n": [int(n.sum())]})

    made = found.repartition(1).sortWithinPartitions("part").mapInPandas(write, "path string, n long").first()
    return (made.path, made.n) if made else (None, 0)


class Words:
    """Level 1, by range of hashes: ``bits`` leading bits are the part that a segment holds."""

    def __init__(self, directory: str | None, bits: int, n_words: int):
        self.bits, self.n = bits, n_words
        self.segments = Segments(directory, lambda load: (EliasFano.read(load, ""), load("counts")))
        self.part = self.segments.column("part")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted hashes; the id of an unknown word is the number of words + 1."""
        ids, counts = np.full(len(h), self.n + 1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        starts = np.searchsorted(h, self.part.astype(np.uint64) << np.uint64(64 - self.bits))
        ends = np.searchsorted(h, (((self.part.astype(np.uint64) + np.uint64(1)) << np.uint64(64 - self.bits)) - np.uint64(1)), side="right")
        for s in np.flatnonzero(starts < ends):
            a, z = starts[s], ends[s]
            hashes, seen = self.segments[s]
            got = hashes.find(h[a:z] & np.uint64((1 << (64 - self.bits)) - 1))
            ok = got >= 0
            ids[a:z][ok] = got[ok] + self.segments.first[s]
            counts[a:z][ok] = seen[got[ok]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the words with sorted ids."""
        out = np.zeros(len(ids))
        for s, at in self.segments.ranges(ids):
            out[at] = self.segments[s][1][ids[at] - self.segments.first[s]]
        return out


class Level:
    """Children of contexts, by ascending keys."""

    def __init__(self, directory: str | None, vocabulary: int, last: bool):
        self.v = vocabulary
        self.segments = Segments(directory, lambda load: (EliasFano.read(load, "p_"), EliasFano.read(load, "i_"), load("alpha"), load("left"), None if last else load("counts")))
        self.first_key, self.first_ctx, self.last_ctx, first_sum, last_sum = (self.segments.column(c) for c in ("first_key", "first_ctx", "last_ctx", "first_sum", "last_sum"))
        many = self.first_ctx != self.last_ctx
        self.edge_ctx, back = np.unique(np.concatenate([self.first_ctx, self.last_ctx[many]]), return_inverse=True)
        self.edge_left = np.maximum(1 - np.bincount(back, weights=np.concatenate([first_sum, last_sum[many]])), 1e-12)

    def find(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, discounted probability or 0) of the children; (ctx, word) is sorted, a ctx below 0 has none."""
        rank, alpha = np.full(len(ctx), -1, dtype=np.int64), np.zeros(len(ctx))
        cut = np.searchsorted(ctx * self.v + word, self.first_key)
        ends = np.append(cut[1:], len(ctx))
        for i in np.flatnonzero(cut < ends):
            a, c0 = cut[i], self.first_ctx[i]
            inside = np.flatnonzero(ctx[a : ends[i]] <= self.last_ctx[i]) + a
            if not len(inside):
                continue
            pointers, children, codes, _, _ = self.segments[i]
            near = ctx[inside] - c0
            new = np.append(True, near[1:] != near[:-1])
            some, back = near[new], np.cumsum(new) - 1
            lo, hi = (x.astype(np.int64) for x in pointers.get_two(some))
            base = np.zeros(len(some), dtype=np.int64)
            base[lo > 0] = children.get(lo[lo > 0] - 1).astype(np.int64)
            at = children.find((base[back] + word[inside] + 1).astype(np.uint64))
            ok = (at >= lo[back]) & (at < hi[back])
            rank[inside[ok]], alpha[inside[ok]] = self.segments.first[i] + at[ok], decode(codes[at[ok]])
        return rank, alpha

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        """Counts of the children with sorted ranks."""
        out = np.ones(len(ranks))
        for i, at in self.segments.ranges(ranks):
            out[at] = self.segments[i][4][ranks[at] - self.segments.first[i]]
        return out

    def left(self, ctx: np.ndarray) -> np.ndarray:
        """The mass that each of the sorted contexts leaves to shorter ones."""
        out = np.ones(len(ctx))
        starts, ends = np.searchsorted(ctx, self.first_ctx), np.searchsorted(ctx, self.last_ctx, side="right")
        for i in np.flatnonzero(starts < ends):
            some = ctx[starts[i] : ends[i]]
            out[starts[i] : ends[i]] = decode(self.segments[i][3][some - self.first_ctx[i]])
        if len(self.edge_ctx):
            at = np.minimum(np.searchsorted(self.edge_ctx, ctx), len(self.edge_ctx) - 1)
            out = np.where(self.edge_ctx[at] == ctx, self.edge_left[at], out)
        return out


_levels: dict[str, object] = {}


def _cached(name: str, make):
    if name not in _levels:
        if len(_levels) > 8:
            _levels.clear()
        _levels[name] = make()
    return _levels[name]


# ---------------------------------------------------------------- counting


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Sums of keys, given out as rows (part, keys, counts) when many have come."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.held, self.n = bounds, [], 0

    def add(self, keys: np.ndarray):
        u, c = np.unique(keys, return_counts=True)
        self.held.append((u, c))
        self.n += len(keys)
        if self.n >= TOKENS_AT_ONCE:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        keys, counts = _sums(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))
        self.held, self.n = [], 0
        cut = [0, *np.searchsorted(keys, self.bounds), len(keys)]
        rows = [(p, pack_keys(keys[a:z]), pack_counts(counts[a:z])) for p, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary())], names=["part", "keys", "counts"])


def _squeezed(values: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, as the heavy ones are mostly zero, and are compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """The first key and the steps to the next ones."""
    steps = np.diff(keys)
    small = not len(steps) or int(steps.max()) < 2**32
    return keys[:1].tobytes() + _squeezed(steps.astype("<u4" if small else "<u8"))


def unpack_keys(data: bytes, dtype) -> np.ndarray:
    steps = _unsqueezed(data[8:])
    out = np.empty(len(steps) + 1, dtype=dtype)
    out[0] = np.frombuffer(data, dtype=dtype, count=1)[0]
    out[1:] = steps
    return np.cumsum(out, dtype=dtype)


def pack_counts(counts: np.ndarray) -> bytes:
    return _squeezed(counts.astype("<u1" if counts.max() < 256 else "<u8"))


def unpack_counts(data: bytes) -> np.ndarray:
    return _unsqueezed(data).astype(np.int64)


PACKED = "part int, keys binary, counts binary"


def _totals(pdf: pd.DataFrame, dtype) -> tuple[np.ndarray, np.ndarray]:
    return _sums(np.concatenate([unpack_keys(k, dtype) for k in pdf["keys"]]), np.concatenate([unpack_counts(c) for c in pdf["counts"]]))


def _word_level(train: DataFrame, folder: str, n_docs: int) -> tuple[str | None, int, int, int]:
    """Writes level 1. (directory, leading bits, number of words, number of word tokens)."""
    bits = max(3, int(n_docs // 8000).bit_length())
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def count(batches):
        sums = Counter(bounds)
        for batch in batches:
            for some in slices(batch.column(0)):
                h, _ = word_hashes(some)
                if len(h):
                    yield from sums.add(h)
        yield from sums.flush()

    def build(key, pdf):
        keys, counts = _totals(pdf, np.uint64)
        below = 64 - bits
        part = EliasFano.of(keys & np.uint64((1 << below) - 1), 1 << below)
        path = write_arrays(folder, part.arrays() | {"counts": counts.astype(np.uint32 if counts.max() < 2**32 else np.uint64)})
        return pd.DataFrame({"part": [key[0]], "path": [path], "n": [len(keys)], "tokens": [int(counts.sum())]})

    packed = train.select("text").mapInArrow(count, PACKED)
    packed = packed.repartition(1 << bits, "part")
    found = settle(packed.groupBy("part").applyInPandas(build, "part int, path string, n long, tokens long"), "lm-words")
    directory, n_words = _directory(found, folder)
    return directory, bits, n_words, found.agg(F.sum("tokens").alias("n")).first().n or 0


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<i4" if vocabulary < 2**31 else "<i8")


def _tokens_of(batch: pa.RecordBatch, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, their starts) of an encoded batch."""
    raw, kind = batch.column("ids").to_pylist(), id_type(vocabulary)
    ids = np.frombuffer(b"".join(raw), dtype=kind).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in raw])]).astype(np.int64)


def _small(batches, name: str = "ids"):
    """Slices of some 500,000 tokens, or single longer texts."""
    for batch in batches:
        at = 0
        for some in slices(batch.column(name), IDS_AT_ONCE * 4):
            yield batch.slice(at, len(some))
            at += len(some)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """Discounts of counts 1, 2 and more from the numbers of n-grams seen 1, 2, 3 and 4 times (index 0 is not used)."""
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    y = n1 / (n1 + 2 * n2)
    d = [i - (i + 1) * y * b / a for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *[min(max(x, 0.1), i - 0.1) for i, x in enumerate(d, 1)]])


def _higher_level(encoded: DataFrame, keys_of, context_counts, folder: str, vocabulary: int, tokens: int, n_docs: int, least_count: int, discount: float | None, last: bool) -> tuple[str | None, int]:
    """Counts the keys (context * vocabulary + word) that ``keys_of(ids, starts)`` gives and writes a level of them. (directory, number of keys)."""
    every = max(1, n_docs // SAMPLE_DOCS)

    def some(batches):
        for batch in _small(batches):
            keys = np.unique(keys_of(*_tokens_of(batch, vocabulary)))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([pack_keys(keys[:: max(1, len(keys) // (SAMPLE_KEYS * batch.num_rows))])], pa.binary())], names=["keys"])

    texts = encoded.filter(F.pmod(F.xxhash64("ids"), every) == 0).select("ids").distinct().limit(2 * SAMPLE_DOCS)
    sample = np.concatenate([np.empty(0, np.int64), *[unpack_keys(r.keys, np.int64) for r in texts.mapInArrow(some, "keys binary").collect()]])
    parts = max(8, tokens // TOKENS_AT_ONCE)
    bounds = np.unique(np.quantile(sample, np.arange(1, parts) / parts, method="nearest")) if len(sample) else np.empty(0, np.int64)

    def count(batches):
        sums = Counter(bounds)
        for batch in _small(batches):
            keys = keys_of(*_tokens_of(batch, vocabulary))
            if len(keys):
                yield from sums.add(keys)
        yield from sums.flush()

    def add_up(key, pdf):
        keys, counts = _totals(pdf, np.int64)
        keep = counts >= least_count
        keys, counts = keys[keep], counts[keep]
        if not len(keys):
            return pd.DataFrame(columns=["part", "keys", "counts", "n1", "n2", "n3", "n4"])
        return pd.DataFrame({"part": [key[0]], "keys": [pack_keys(keys)], "counts": [pack_counts(counts)]} | {f"n{i}": [int((counts == i).sum())] for i in (1, 2, 3, 4)})

    packed = encoded.select("ids").mapInArrow(count, PACKED).repartition(len(bounds) + 1, "part")
    path = new_path(encoded.sparkSession, "lm-sums")
    packed.groupBy("part").applyInPandas(add_up, f"{PACKED}, n1 long, n2 long, n3 long, n4 long").write.parquet(path)
    summed = encoded.sparkSession.read.parquet(path)
    seen = summed.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    less = discounts({i: seen[f"n{i}"] or 0 for i in (1, 2, 3, 4)}) if discount is None else np.array([0.0, discount, discount, discount])

    def build(batches):
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            keys, counts = unpack_keys(row["keys"], np.int64), unpack_counts(row["counts"])
            row = {"part": row["part"]}
            ctx, ids = keys // vocabulary, keys % vocabulary
            c0, c1 = int(ctx[0]), int(ctx[-1])
            some_ctx, back = np.unique(ctx, return_inverse=True)
            alpha = (counts - less[np.minimum(counts, 3)]) / context_counts(some_ctx)[back]
            sums = np.bincount(ctx - c0, weights=alpha, minlength=c1 - c0 + 1)
            pointers = np.concatenate([[0], np.cumsum(np.bincount(ctx - c0, minlength=c1 - c0 + 1))])
            last_of = np.flatnonzero(np.append(ctx[1:] != ctx[:-1], True))
            ascending = (np.cumsum(ids[last_of] + 1) - ids[last_of] - 1)[back] + ids + 1
            arrays = {f"p_{k}": a for k, a in EliasFano.of(pointers, len(keys) + 1).arrays().items()}
            arrays |= {f"i_{k}": a for k, a in EliasFano.of(ascending, int(ascending[-1]) + vocabulary + 2).arrays().items()}
            arrays |= {"alpha": code(alpha), "left": code(1 - sums)}
            if not last:  # the next level's context counts
                arrays["counts"] = counts.astype(np.min_scalar_type(int(counts.max())))
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "path": [write_arrays(folder, arrays)], "n": [len(keys)], "first_key": [int(keys[0])], "first_ctx": [c0], "last_ctx": [c1], "first_sum": [float(sums[0])], "last_sum": [float(sums[-1])]})

    shape = "part int, path string, n long, first_key long, first_ctx long, last_ctx long, first_sum double, last_sum double"
    made = _directory(settle(summed.select("part", "keys", "counts").mapInArrow(build, shape), "lm-level"), folder)
    drop_folder(path)
    return made


def _bigrams(end: int):
    def keys(ids, starts):
        before = np.concatenate([[end], ids[:-1]]) if len(ids) else ids
        before[starts[:-1][starts[:-1] < len(ids)]] = end
        ok = (ids <= end) & (before <= end)
        return before[ok] * (end + 2) + ids[ok]

    return keys


class Pairs:
    """Looks up the bigrams of texts in level 2, each distinct one once."""

    def __init__(self, level: Level, end: int):
        self.level, self.end, self.v = level, end, end + 2

    def find(self, ids: np.ndarray, starts: np.ndarray):
        before = np.concatenate([[self.end], ids[:-1]])
        before[starts[:-1]] = self.end
        keys, back = np.unique(before * self.v + ids, return_inverse=True)
        rank, alpha = self.level.find(keys // self.v, keys % self.v)
        return before, rank[back], alpha[back]


def _trigrams(find_pairs, vocabulary: int):
    """Keys (rank of the bigram before, word), where both bigrams of the trigram were kept."""

    def keys(ids, starts):
        if len(ids) < 2:
            return np.empty(0, np.int64)
        _, rank, _ = find_pairs().find(ids, starts)
        context = np.concatenate([[-1], rank[:-1]])
        context[starts[:-1]] = -1
        ok = (context >= 0) & (rank >= 0)
        return context[ok] * vocabulary + ids[ok]

    return keys


def score_texts(docs: DataFrame, least_count: int = 1, discount: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model learns from those not held out.

    With ``discount`` one discount holds for all counts, else each level's are estimated.
    """
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    n_docs = rows.filter(~F.col("held_out")).count()
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "lm")
    directory, bits, end, n_words = _word_level(rows.filter(~F.col("held_out")), folder, n_docs)
    tokens, vocabulary = n_words + n_docs, end + 2  # ids: words, the end, unknown
    distinct = end + (1 if n_docs else 0)
    words = lambda: _cached(f"{folder}1", lambda: Words(directory, bits, end))

    def encode(batches):
        for batch in batches:
            for some, at in _with_places(batch):
                h, starts = word_hashes(some)
                u, back = np.unique(h, return_inverse=True)
                ids, counts = words().find(u)
                ids, logs = ids[back], np.log10((counts[back] + 1) / (tokens + distinct + 1))
                n = np.diff(starts)
                base = np.array([logs[a:z].sum() for a, z in zip(starts[:-1], starts[1:])]) + np.log10((n_docs + 1) / (tokens + distinct + 1))
                known = np.concatenate([[0], np.cumsum(counts[back] > 0)])
                flat = np.insert(ids, starts[1:], end).astype(id_type(vocabulary))
                cut = starts + np.arange(len(starts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), pa.array(n + 1), pa.array(known[starts[1:]] - known[starts[:-1]] + (1 if n_docs else 0)), pa.array(base), pa.array([flat[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"],
                )

    encoded = settle(rows.mapInArrow(encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary"), "lm-ids", compression="zstd")
    train = encoded.filter(~F.col("held_out"))

    def word_counts(ctx):
        """Counts of sorted contexts: words, and the end."""
        out = np.full(len(ctx), float(n_docs))
        some = ctx < end
        out[some] = words().counts(ctx[some])
        return out

    two, n_pairs = _higher_level(train, _bigrams(end), word_counts, folder, vocabulary, tokens, n_docs, least_count, discount, False)
    level2 = lambda: _cached(f"{folder}2", lambda: Level(two, vocabulary, False))
    pairs = lambda: Pairs(level2(), end)

    if n_pairs * vocabulary >= 2**63:
        raise ValueError("keys of 64 bits do not hold the pairs of this corpus")
    three, _ = _higher_level(train, _trigrams(pairs, vocabulary), lambda ctx: level2().counts(ctx), folder, vocabulary, tokens, n_docs, least_count, discount, True)
    level3 = lambda: _cached(f"{folder}3", lambda: Level(three, vocabulary, True))

    def left_of(level, ctx):
        u, back = np.unique(ctx, return_inverse=True)
        return level.left(u)[back]

    def score(batches):
        for batch in _small(batches):
            ids, starts = _tokens_of(batch, vocabulary)
            if not len(ids):
                continue
            before, rank, alpha = pairs().find(ids, starts)
            u, back = np.unique(ids, return_inverse=True)
            count = np.zeros(len(u))
            count[u <= end] = word_counts(u[u <= end])
            p = ((count + 1) / (tokens + distinct + 1))[back]
            p = alpha + left_of(level2(), before) * p
            context = np.concatenate([[-1], rank[:-1]])
            context[starts[:-1]] = -1
            at = np.flatnonzero(context >= 0)
            if len(at):
                keys, back = np.unique(context[at] * vocabulary + ids[at], return_inverse=True)
                ctx = keys // vocabulary
                _, more = level3().find(ctx, keys % vocabulary)
                p[at] = more[back] + level3().left(ctx)[back] * p[at]
            logs = np.log10(np.minimum(p, 1.0))
            total = np.add.reduceat(logs, starts[:-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")], pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    got = encoded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _with_places(batch: pa.RecordBatch):
    at = 0
    for some in slices(batch.column(2)):
        yield some, at
        at += len(some)


def op10_ngram_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
