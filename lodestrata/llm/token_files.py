"""Token ids in Arrow stream-file format: fixed-size-list batches of equal-length sequences with masks.

Documents are dealt into ranges of doc_id, and each task encodes its range and writes two Arrow
files into a folder that all executors reach: ``part-*.arrow`` with columns ids and mask, both
fixed-size lists of ``length`` (2048) values, batches of 256 sequences, not compressed, so that a
reader maps the file and gets any sequence and its mask (Arrow bits) without copying or decoding; and ``part-*.docs.arrow``
with doc_id, start (in this part) and n_tokens. ids have 16 bits where the vocabulary allows. Only
the last sequence of a part is padded; its mask is false there. A part's files get names of their
own in each attempt, and the table of parts, which Spark commits, names those of the attempt that
ended; an attempt that is lost leaves files that nothing names.

A byte-level BPE never merges across the start of a word, so a text is cut before single spaces. Arrow tells the words of some 4 MB
of texts apart, each distinct one is looked up once, without its final marks, and its ids are taken to each place. What is
new to a cache of a million pieces is encoded by the library, a thousand pieces as one text: each ends with an id, which the lengths of the ids' texts
show. A full cache keeps what the present texts use.
A text that holds the string of a special token is encoded whole, as the library does by itself; with ``special_as_text`` such strings are plain text.

Defined results: a null text is encoded as an empty one; every document ends with the end id;
equal doc_ids are put in the order of a hash of their texts, and then of the texts, null ids first, and may lie in several parts; an
empty table gives no files. Other columns of the input are not used.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import new_path, settle, table

LENGTH, SEQUENCES_A_BATCH, CACHED, AT_ONCE = 2048, 256, 1_000_000, 1 << 22
MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_tokens long"
_INSIDE_SPACE = re.compile(r"(?:^|\s) (?:\s|$)")
#: The same for RE2; it may find more, as each text that it finds is cut by the other.
_PERHAPS_INSIDE_SPACE = r"(?:\A|[\s\v\x1c-\x1f\x{85}\pZ]) (?:[\s\v\x1c-\x1f\x{85}\pZ]|\z)"
_MARKS, _BEGINS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", (" ", "\n")
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts by pieces, each by the tokenizers library once while it is cached."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        #: Pieces, and those that begin with a space without it.
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        #: Bytes of each id's text: a byte-level token has a character for each.
        self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.joins = not any(" " in s or "\n" in s for s in self.special)

    def pieces(self, text: str) -> list[str]:
        """Cut before each space that follows or precedes something else than white space; not at all where a special token is."""
        if any(s in text for s in self.special):
            return [text]
        parts = text.split(" ")
        if not _INSIDE_SPACE.search(text):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            if (last and not last[-1].isspace()) or (p and not p[0].isspace()):
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (none null). Words of all texts are told apart by Arrow, so each distinct one is looked up once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, _PERHAPS_INSIDE_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        bounds, words = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        # The first piece of a text has no space before it.
        heads, place = np.unique(code[bounds[:-1]], return_inverse=True)
        code[bounds[:-1]] = len(words.dictionary) + place
        known = pa.concat_arrays([self._spaced(words.dictionary), pa.array(self._pieces(words.dictionary.take(pa.array(heads)).to_pylist()), pa.large_binary())])
        got = known.take(pa.array(code))
        ends, data = np.frombuffer(got.buffers()[1], dtype=np.int64)[bounds].tolist(), memoryview(got.buffers()[2] or b"")
        out = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            pieces = self.pieces(texts[i].as_py())
            out[i] = self._alone(pieces)[0] if len(pieces) == 1 else b"".join(self._pieces(pieces))
        return out

    def _spaced(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of distinct words, each after a space; see ``_parts`` for what is looked up."""
        lines = pc.match_substring(words, "\n")
        stems = pc.utf8_rtrim(words, _MARKS)
        marked = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1)))
        marked = pc.and_not(marked, lines)
        parts = [_parts(w) for w in words.filter(lines).to_pylist()]
        rest = [p[1:] for p in parts]
        tails = [w[n:] for w, n in zip(words.filter(marked).to_pylist(), pc.utf8_length(stems.filter(marked)).to_pylist())]
        firsts = pc.replace_with_mask(pc.if_else(marked, stems, words), lines, pa.array([p[0] for p in parts], words.type)).dictionary_encode()
        names = firsts.dictionary.to_pylist()
        found = list(map(self.spaced.get, names))
        others = {x for r in rest for x in r}.union(tails)
        new = [" " + w for w, x in zip(names, found) if x is None]
        self._learn([*new, *[x for x in others if x not in self.cache]])
        if new:
            found = list(map(self.spaced.get, names))
        after = pa.nulls(len(words), pa.large_binary()).fill_null(b"")
        after = pc.replace_with_mask(after, marked, pa.array([self.cache[x] for x in tails], pa.large_binary()))
        after = pc.replace_with_mask(after, lines, pa.array([b"".join([self.cache[x] for x in r]) for r in rest], pa.large_binary()))
        out = pc.binary_join_element_wise(pa.array(found, pa.large_binary()).take(firsts.indices), after, pa.scalar(b"", pa.large_binary()))
        if len(self.cache) + len(self.spaced) > CACHED:
            self.spaced, self.cache = dict(zip(names, found)), {x: self.cache[x] for x in others}
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of whole pieces."""
        self._learn([p for p in set(pieces) if not self._has(p)])
        return [self.spaced[p[1:]] if p[:1] == " " else self.cache[p] for p in pieces]

    def _has(self, piece: str) -> bool:
        return piece[1:] in self.spaced if piece[:1] == " " else piece in self.cache

    def _keep(self, piece: str, data: bytes) -> None:
        if piece[:1] == " ":
            self.spaced[piece[1:]] = data
        else:
            self.cache[piece] = data

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces; those that begin a token wherever they stand a thousand at a time, as one text."""
        joined = [p for p in pieces if p[:1] in _BEGINS and not p[1:2].isspace() and not p[-1].isspace()] if self.joins else []
        for at in range(0, len(joined), 1000):
            self._learn_joined(joined[at : at + 1000])
        rest = [p for p in pieces if not self._has(p)]
        for piece, data in zip(rest, self._alone(rest)):
            self._keep(piece, data)

    def _learn_joined(self, pieces: list[str]) -> None:
        """Encodes one text of all pieces and keeps each one's ids; none where a piece does not end with an id."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends, want = np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(pa.array(pieces)).to_numpy(), dtype=np.int64)
        if not len(ends) or ends[-1] != want[-1]:
            return
        at = np.searchsorted(ends, want)
        if (ends[at] == want).all():
            data, start = ids.tobytes(), 0
            for piece, end in zip(pieces, ((at + 1) * self.dtype.itemsize).tolist()):
                self._keep(piece, data[start:end])
                start = end

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []


def _parts(piece: str) -> list[str]:
    """A piece cut before each line feed between two other than white space, and its lines before their final marks that follow a letter or digit."""
    lines = piece.split("\n")
    if len(lines) > 1 and any(not a or not b or a[-1].isspace() or b[0].isspace() for a, b in zip(lines, lines[1:])):
        return [piece]
    out = []
    for i, line in enumerate(lines):
        line = "\n" + line if i else line
        stem = line.rstrip(_MARKS)
        if len(stem) < len(line) and stem[-1:].isalnum():
            out += [stem, line[len(stem) :]]
        else:
            out.append(line)
    return out


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One for each process and vocabulary file."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, special_as_text)
    return _encoders[key]


def _fixed(values: np.ndarray | pa.Array, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values) if isinstance(values, np.ndarray) else values, length)


class SequenceWriter:
    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype, self.held, self.n = length, dtype, bytearray(), 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.batch_bytes = SEQUENCES_A_BATCH * length * dtype.itemsize

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n += len(ids) // self.dtype.itemsize
        while len(self.held) >= self.batch_bytes:
            self._write(bytes(self.held[: self.batch_bytes]), self.batch_bytes)
            del self.held[: self.batch_bytes]

    def _write(self, data: bytes, real: int) -> None:
        ids = np.frombuffer(data, dtype=self.dtype)
        mask = np.arange(len(ids)) < real // self.dtype.itemsize
        self.out.write_batch(pa.record_batch([_fixed(ids, self.length), _fixed(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            one = self.length * self.dtype.itemsize
            self._write(bytes(self.held).ljust(-(-len(self.held) // one) * one, b"\0"), len(self.held))
        self.out.close()


def open_store(uri: str):
    """(filesystem, path) of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_arrow(uri: str):
    """A reader of an Arrow file; a local file is mapped."""
    from pyarrow import fs

    store, path = open_store(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


class SequenceFile:
    """Random access to the ids of a part by position."""

    def __init__(self, uri: str):
        self.reader = open_arrow(uri)
        self.length = self.reader.schema.field("ids").type.list_size
        self.step = SEQUENCES_A_BATCH * self.length
        self.last: tuple[int, np.ndarray] = (-1, np.array([]))

    def mapped(self, i: int) -> tuple[pa.Array, pa.BooleanArray]:
        """ids and mask of a sequence as views of the file; a mask has a bit for each place."""
        batch = self.reader.get_batch(i // SEQUENCES_A_BATCH)
        row = i % SEQUENCES_A_BATCH
        return batch.column("ids")[row].values, batch.column("mask")[row].values

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for numpy: ids are a view, and the mask is unpacked, as numpy has no bits."""
        ids, mask = self.mapped(i)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def batch(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            self.last = (i, self.reader.get_batch(i).column("ids").flatten().to_numpy())
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            values = self.batch(start // self.step)
            got = values[start % self.step :][:n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, length: int = LENGTH, special_as_text: bool = False) -> DataFrame:
    """Encodes doc_id, text and writes the files into ``folder``. Returns the table of parts, in ascending order of doc_id.

    The second column of the ranges parts the rows of a doc_id that repeats often.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc, store, part = encoder(vocabulary, special_as_text), None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if store is None:
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                name = f"part-{part:05d}-{uuid.uuid4().hex}"
                sinks = [store.open_output_stream(f"{root}/{name}{end_}") for end_ in (".arrow", ".docs.arrow")]
                seqs, index = SequenceWriter(sinks[0], enc.dtype, length), pa.ipc.new_file(sinks[1], doc_schema)
            ids, texts = batch.column(0), batch.column(1)
            # Texts of some 4 MB at a time.
            size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            cuts = [*np.flatnonzero(np.diff(size // AT_ONCE, prepend=-1)).tolist(), len(texts)]
            for at, to in zip(cuts, cuts[1:]):
                got = [x + end for x in enc.encode(texts[at:to])]
                n = np.array([len(x) for x in got], dtype=np.int64) // enc.dtype.itemsize
                start = seqs.n + np.concatenate([[0], np.cumsum(n)[:-1]])
                seqs.add(b"".join(got))
                index.write_batch(pa.record_batch([ids[at:to].cast(pa.int64()), pa.array(start.astype(np.int64)), pa.array(n)], schema=doc_schema))
                n_docs += len(n)
        if store is not None:
            seqs.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_file": [f"{folder}/{name}.arrow"], "docs_file": [f"{folder}/{name}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [seqs.n]})

    return settle(ordered.mapInArrow(write, MANIFEST), "token-parts")


def read_documents(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    placed = parts.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = placed.select("ids_file", "docs_file", "offset", "part").repartitionByRange(max(1, parts.count()), "part")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceFile(row["ids_file"])
                docs = open_arrow(row["docs_file"])
                for i in range(docs.num_record_batches):
                    d = docs.get_batch(i)
                    start, n = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(ids.ids(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(start + row["offset"]), d.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-files"))
    return read_documents(parts)
