"""Phrase collocation mining in the way of SON: shards are mined at a lowered support, then candidates are counted exactly.

The partitions of the tokenised corpus are dealt to a fixed number of shards. A phrase that occurs
``support`` times in all occurs in some shard at least in proportion to the shard's share of all words, so
mining every shard completely at that local support misses nothing, and the union of what is frequent somewhere holds every frequent phrase. A last
pass counts that union over everything. The number of shards is fixed and a shard is mined by as
many tasks as it has files: with shards as large as a task, the local support would fall below one
occurrence once the corpus is large, and everything would be a candidate.

Within a shard phrases grow by a word a level. A phrase of m words is counted only where both its parts of m - 1
words are frequent in some shard; tasks know that from a bitmap of hashes with a fixed upper size, in which a false hit
costs a count and nothing else. Local counts are those of 48-bit hashes, packed by (shard, range of hashes): where two
phrases share one, both become candidates sooner, and none is missed. The last pass counts phrases, not hashes. Tasks sum what they read before
anything is shuffled, so a common phrase is one entry a task.

Words are known by 64-bit hashes of language and word. Words that share a hash are found in the
vocabulary, and the corpus is then tokenised again with another hash for these, so counts are exact.

Defined results: a null text is empty, a null language is ``und``; repeated rows count each; A-Z are
lower-cased and no other letters; phrases do not cross ``.,;:!?`` or a line break; scores are floors of exact quotients; an empty table
gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import checked, settle, table
from lodestrata.llm.ngram_lm import pack_counts, pack_keys, unpack_counts, unpack_keys

SHARDS = 4
SUPPORT, MOST_WORDS, TOP = 100, 5, 2000
TOKENS_AT_ONCE = 500_000
#: Hashes of phrases have so many bits; so many of them are summed in one group of a shard.
HASH_BITS, HASHES_A_GROUP = 48, 1_000_000
#: A bitmap has 16 bits for each phrase, up to 2**27 bits (16 MB); beyond that more phrases are counted in vain.
BITS_EACH, MOST_BITS = 16, 1 << 27
BREAK = b"\xff"  # in no UTF-8 text
_SPLIT = bytes(10 if chr(i) in ".,;:!?\n\v\f\r" else i for i in range(256))
CHUNK = "lang string, codes binary, ids array<long>, words array<binary>, counts array<long>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased, with a break between pieces."""
    return text.lower().translate(_SPLIT).replace(b"\n", b" \xff ").split()


def hash_word(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _id(lang: str, word: bytes, others: frozenset) -> int:
    key = lang.encode() + b"\x00" + word
    got = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little") if key in others else hash_word(key)
    return (got or 1) - (1 << 64 if got >= 1 << 63 else 0)


class _Codes(dict):
    """word -> number in the order of first use; 0 is the break."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def tokenized(docs: DataFrame, others: frozenset = frozenset()) -> DataFrame:
    """Written chunks of one language: shard, codes (32-bit numbers into the chunk's words, 0 between pieces), and of its words ids, words, counts."""

    def chunk(lang: str, held: list, known: _Codes):
        codes = np.concatenate(held)
        words = list(known)[1:]
        counts = np.bincount(codes, minlength=len(known))[1:]
        ids = np.fromiter((_id(lang, w, others) for w in words), np.int64, len(words))
        ends = pa.array([0, len(words)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((ids, pa.int64()), (words, pa.binary()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), *lists], names=["lang", "codes", "ids", "words", "counts"])

    def run(batches):
        held: dict[str, tuple[list, _Codes]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                codes, known = held.setdefault(lang.as_py(), ([], _Codes({BREAK: 0})))
                words = words_of(text.as_py())
                codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                codes.append(np.zeros(1, np.uint32))
                n += len(words) + 1
                if n >= TOKENS_AT_ONCE:
                    for lg, (c, k) in held.items():
                        yield chunk(lg, c, k)
                    held, n = {}, 0
        for lg, (c, k) in held.items():
            yield chunk(lg, c, k)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return settle(rows.mapInArrow(run, CHUNK).withColumn("shard", F.pmod(F.spark_partition_id(), SHARDS)), "phrase-tokens", compression="zstd")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Written: lang, id, word, n."""
    each = chunks.select("lang", F.explode(F.arrays_zip("ids", "words", "counts")).alias("w")).select("lang", F.col("w.ids").alias("id"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    return settle(each.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")), "phrase-words")


def corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vocabulary) in which every id is one word. Words that share a hash are too few to mind: one pair in 2 ** 64."""
    others: frozenset = frozenset()
    while True:
        chunks = tokenized(docs, others)
        words = vocabulary(chunks)
        shared = words.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
        more = {r.lang.encode() + b"\x00" + bytes(r.word) for r in words.join(shared.hint("merge"), "id", "left_semi").select("lang", "word").collect()}
        if not more:
            return chunks, words
        if more <= others:
            raise RuntimeError("two words share both hashes")
        others |= more


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its beginning and its last word."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - HASH_BITS)).view(np.int64)


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def places(codes: np.ndarray, ids: np.ndarray, bitmaps: list[np.ndarray], upto: int):
    """Yields (m, places, hashes) of the phrases of 2 to ``upto`` words whose shorter parts are in the bitmaps; ids[0] belongs to the break."""
    at = np.flatnonzero(np.concatenate([[False], _in(bitmaps[0], ids[1:])])[codes])
    h = ids[codes[at]]
    for m in range(2, upto + 1):
        next_to = np.flatnonzero(np.diff(at) == 1)
        at = at[next_to]
        h = _mix(h[next_to], ids[codes[at + m - 1]])
        yield m, at, h
        if m < upto:
            kept = _in(bitmaps[m - 1], h)
            at, h = at[kept], h[kept]


def mined(chunks: DataFrame, bitmaps: list[np.ndarray], m: int, least: dict[int, int], tokens: int) -> DataFrame:
    """h: the hashes of m-word phrases that occur in a shard as often as ``least`` says for it."""
    shared = chunks.sparkSession.sparkContext.broadcast(bitmaps)  # each of at most MOST_BITS
    bits = max(3, (tokens // (SHARDS * HASHES_A_GROUP)).bit_length())
    bounds = np.arange(1, 1 << bits, dtype=np.int64) << (HASH_BITS - bits)

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def flush():
            for shard, some in held.items():
                keys, counts = np.unique(np.concatenate(some), return_counts=True)
                cut = [0, *np.searchsorted(keys, bounds), len(keys)]
                rows = [(p, pack_keys(keys[a:z]), pack_counts(counts[a:z])) for p, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array([p for p, _, _ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary())], names=["shard", "part", "keys", "counts"])

        for shard, codes, ids in _chunks(batches):
            for k, at, h in places(codes, ids, shared.value, m):
                if k == m and len(h):
                    held.setdefault(shard, []).append(h)
                    n += len(h)
            if n >= 4 * TOKENS_AT_ONCE:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    def add_up(key, pdf):
        keys, counts = np.concatenate([unpack_keys(k, np.int64) for k in pdf["keys"]]), np.concatenate([unpack_counts(c) for c in pdf["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pd.DataFrame({"h": keys[first][np.add.reduceat(counts, first) >= least[key[0]]]})

    packed = chunks.select("shard", "codes", "ids").mapInArrow(run, "shard int, part int, keys binary, counts binary")
    return packed.groupBy("shard", "part").applyInPandas(add_up, "h long").distinct()


def _chunks(batches):
    """(shard, codes, ids) of each chunk; ids[0] belongs to the break."""
    for batch in batches:
        for shard, codes, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
            yield shard.as_py(), np.frombuffer(codes.as_py(), np.uint32), np.append(0, ids.values.to_numpy()).astype(np.int64)


def _sums(h: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases (rows of ids) in the order of their hashes, and the sums of their counts."""
    order = np.lexsort((*words.T, h))
    h, words, counts = h[order], words[order], counts[order]
    new = np.ones(len(h), bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    first = np.flatnonzero(new)
    return h[first], words[first], np.add.reduceat(counts, first)


def counted(chunks: DataFrame, bitmaps: list[np.ndarray], least: int, tokens: int) -> DataFrame:
    """words, h, n: how often each phrase occurs whose hash is in the bitmap of its length, where that is ``least`` or more."""
    shared = chunks.sparkSession.sparkContext.broadcast(bitmaps)
    bits = max(5, (tokens // HASHES_A_GROUP).bit_length())
    bounds = np.arange(1, 1 << bits, dtype=np.int64) << (HASH_BITS - bits)

    def run(batches):
        held: dict[int, list] = {}
        n = 0

        def flush():
            for m, found in held.items():
                h, words, counts = _sums(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), np.ones(sum(len(a) for a, _ in found), np.int64))
                cut = [0, *np.searchsorted(h, bounds), len(h)]
                rows = [(p, pack_keys(h[a:z]), words[a:z].tobytes(), pack_counts(counts[a:z])) for p, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
                part, keys, flat, sums = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(rows), pa.int32()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(flat, pa.binary()), pa.array(sums, pa.binary())], names=["m", "part", "keys", "words", "counts"])

        for _, codes, ids in _chunks(batches):
            for m, at, h in places(codes, ids, shared.value, len(shared.value)):
                kept = _in(shared.value[m - 1], h)
                at, h = at[kept], h[kept]
                if len(at):
                    held.setdefault(m, []).append((h, ids[codes[at[:, None] + np.arange(m)]]))
                    n += len(at)
            if n >= 2 * TOKENS_AT_ONCE:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    def add_up(key, pdf):
        parts = [np.concatenate(x) for x in ([unpack_keys(k, np.int64) for k in pdf["keys"]], [np.frombuffer(w, np.int64).reshape(-1, key[0]) for w in pdf["words"]], [unpack_counts(c) for c in pdf["counts"]])]
        h, words, n = _sums(*parts)
        kept = n >= least
        return pd.DataFrame({"words": pd.Series(list(words[kept]), dtype=object), "h": h[kept], "n": n[kept]})

    packed = chunks.select("shard", "codes", "ids").mapInArrow(run, "m int, part int, keys binary, words binary, counts binary")
    return packed.groupBy("m", "part").applyInPandas(add_up, "words array<long>, h long, n long")


def bitmap_of(hashes: DataFrame, n: int) -> np.ndarray:
    """The bitmap of a column h with n rows, at most MOST_BITS long."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1  # the functions count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def frequent(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words array<long>, a: every word and phrase with its exact count where that is ``support`` or more; the vocabulary of such words: id, lang, word, n (all words of its language))."""
    chunks, words = corpus(docs)
    langs = settle(words.groupBy("lang").agg(F.sum("n").alias("all")), "phrase-languages")
    often = settle(words.filter(F.col("n") >= support).join(checked(langs), "lang").select("id", "lang", F.col("word").cast("string").alias("word"), "n", "all"), "phrase-often")
    bitmaps = [bitmap_of(often.select(F.col("id").alias("h")), often.count())]
    sizes = {r.shard: r.n for r in chunks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}  # SHARDS rows
    total = sum(sizes.values())
    least = {s: -(-support * n // total) if total else 1 for s, n in sizes.items()}
    candidates = None
    for m in range(2, most_words + 1):
        local = settle(mined(chunks, bitmaps, m, least, total), "phrase-local")
        bitmaps.append(bitmap_of(local, local.count()))
        candidates = local if candidates is None else candidates.unionAll(local)
    everywhere = counted(chunks, bitmaps, support, total)
    phrases = everywhere.join(candidates.hint("merge"), "h", "left_semi").select("words", F.col("n").alias("a"))
    return settle(phrases.unionAll(often.select(F.array("id"), "n")), "phrase-frequent"), often


def collocations(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that stands; a row for each phrase."""
    found, often = frequent(docs, support, most_words)
    size = F.size("words")
    phrases = found.filter(size > 1)
    langs = often.select(F.col("id").alias("first"), F.col("all").alias("n"))
    # the longest count among the phrases that hold a phrase
    starts = F.sequence(F.lit(1), F.lit(most_words))
    inner = phrases.filter(size > 2).select("a", "words", F.explode(starts).alias("i")).select("a", "words", "i", F.explode(F.sequence(F.lit(2), F.lit(most_words))).alias("k"))
    parts = inner.filter((F.col("k") < size) & (F.col("i") + F.col("k") <= size + 1)).select(F.slice("words", F.col("i"), F.col("k")).alias("words"), "a")
    longer = settle(parts.groupBy("words").agg(F.max("a").alias("longer")), "phrase-longer")
    kept = phrases.join(longer.hint("merge"), "words", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = settle(kept.select("words", "a").join(checked(settle(langs, "phrase-n")), F.col("words")[0] == F.col("first")).drop("first"), "phrase-kept")
    cuts = kept.select("words", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    named = lambda side, count: found.select(F.col("words").alias(side), F.col("a").alias(count))
    both = cuts.join(named("left", "l").hint("merge"), "left").join(named("right", "r").hint("merge"), "right")
    score = F.expr("(1000BD * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = both.withColumn("score", score).groupBy("words").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = settle(best, "phrase-scores")
    each = best.select("words", F.posexplode("words").alias("i", "id"))
    text = each.join(checked(often.select("id", "lang", "word")), "id").groupBy("words").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = best.join(settle(text.select("words", "lang", F.concat_ws(" ", "w.word").alias("phrase")), "phrase-texts").hint("merge"), "words")
    return named.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL HAVING count(*) >= {SUPPORT}),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
b AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS a FROM s, (SELECT unnest(range(1, {MOST_WORDS})) AS i), (SELECT unnest(range(2, {MOST_WORDS})) AS k) WHERE k < m AND i + k <= m + 1 GROUP BY ALL),
c AS (SELECT s.*, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM s, (SELECT unnest(range(1, {MOST_WORDS})) AS k) WHERE m > 1 AND k < m AND NOT EXISTS (SELECT 1 FROM b WHERE b.lang = s.lang AND b.phrase = s.phrase AND 100 * b.a >= 100 * s.a)),
x AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, (1000 * c.a * n.n) // (x.a * y.a) AS score, k FROM c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q JOIN n ON n.lang = c.lang),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= {TOP}"""
