"""Token ids of documents in binary files of patched frame-of-reference blocks.

The ids of all documents, one after another in the order of their ids, are cut
into blocks of ``BLOCK`` ids.  A block stores its smallest id; the differences
from it are packed with the number of bits that a given share of them needs
(a percentile), and the high bits of the others stand in an exception list with
their places.  A footer holds the byte offset of every block and the id and
length of every document, so a reader finds any range of ids by itself.

Layout of a file, little-endian::

    "PFORIDS1"
    block:   least u32, count u32, exceptions u32, width u8; then the low bits
             in groups of 64 ids (``width`` words of 64 bits a group), the
             places of the exceptions (u16) and their high bits (u32)
    footer:  offsets of the blocks (u64), document ids (i64), whether an id is
             known (u8), lengths of the documents (u64)
    trailer: offset of the footer, blocks, documents, ids (u64 each), "PFORIDS1"

Documents are range-partitioned and sorted by id, and every task encodes and
writes its range, so texts are shuffled once and encoded once.  A task encodes
each distinct string between white space once and puts the texts together from
them: no token of the vocabulary files in question crosses ASCII white space.
"""
from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.frames import running_by_group, scratch_path, tasks_for, written
from lotline.llm.textnum import blocks
from lotline.llm.warc import _open

MAGIC, BLOCK = b"PFORIDS1", 1024
_HEAD, _TRAILER = struct.Struct("<IIIB"), struct.Struct("<QQQQ8s")
#: Blocks that a writer or reader handles at once, and bytes of text that a task encodes at once.
GROUP, TEXT_BYTES = 256, 1 << 22
#: A worker forgets its strings when it knows more ids or characters than this.
KNOWN_IDS = 6_000_000
#: Strings of characters that keep their form under composition, and those of them that end in a word and a stop.
PLAIN, TAIL = r"^[!-~À-ÖØ-öø-ÿ]*$", r"[0-9a-zß-öø-ÿ][.,]$"
MANIFEST = "slice int, file string, n_docs long, n_ids long"
_BIT = np.uint64(1) << np.arange(33, dtype=np.uint64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers below ``2**width`` as rows of ``width`` words of 64 bits."""
    out = np.zeros((width, len(values)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(values.T.astype(np.uint64)) if width else ()):
        word, shift = divmod(k * width, 64)
        out[word] |= column << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    words = np.ascontiguousarray(words.T)
    out, mask = np.zeros((64, words.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[k] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= words[word + 1] << np.uint64(64 - shift)
        out[k] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, share: float) -> list[bytes]:
    """Blocks of the ids; only the last may be short. ``share`` of a block's differences fit its width."""
    n = len(ids)
    rows = -(-n // BLOCK)
    x = np.full(rows * BLOCK, ids[-1] if n else 0, np.uint64)
    x[:n] = ids
    x = x.reshape(rows, BLOCK)
    least = x.min(axis=1)
    x -= least[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    widths = np.searchsorted(_BIT, np.partition(x, rank, axis=1)[:, rank], "right")
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        y = x[at]
        high = y >> np.uint64(width)
        y &= np.uint64((1 << width) - 1)
        words = pack(y.reshape(-1, 64), width).reshape(len(at), -1)
        for k, row in enumerate(at.tolist()):
            count = min(BLOCK, n - row * BLOCK)
            place = np.flatnonzero(high[k, :count])
            out[row] = b"".join([_HEAD.pack(int(least[row]), count, len(place), width),
                                 words[k, :-(-count // 64) * width].tobytes(),
                                 place.astype("<u2").tobytes(), high[k, place].astype("<u4").tobytes()])
    return out


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that start at these places of ``data``."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    out = np.zeros((len(starts), BLOCK), np.uint64)
    widths = np.array([h[3] for h in heads], np.int64)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width).tolist()
        words = np.zeros((len(at), BLOCK // 64 * width), np.uint64)
        for k, row in enumerate(at):
            size = -(-heads[row][1] // 64) * width
            words[k, :size] = np.frombuffer(data, "<u8", size, starts[row] + _HEAD.size)
        out[at] = unpack(words.reshape(-1, width), width).reshape(len(at), BLOCK)
    for row, (least, count, exceptions, width) in enumerate(heads):
        if exceptions:
            at = starts[row] + _HEAD.size + -(-count // 64) * width * 8
            place = np.frombuffer(data, "<u2", exceptions, at)
            out[row, place] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions).astype(np.uint64) << np.uint64(width)
        out[row] += np.uint64(least)
    counts = np.array([h[1] for h in heads], np.int64)
    return out[np.arange(BLOCK) < counts[:, None]].astype(np.uint32)


class IdWriter:
    """One file: whole groups of blocks as ids come in, then the footer."""

    def __init__(self, uri: str, share: float):
        self.uri, self.share = uri, share
        files, path = _open(uri)
        self.out = files.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.held, self.size, self.ids = len(MAGIC), [], 0, 0
        self.starts: list[int] = []
        self.docs: list[int] = []
        self.known: list[bool] = []
        self.lengths: list[int] = []

    def add(self, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Some documents, in order: their ids and lengths, and their token ids one after another."""
        self.docs += [d or 0 for d in docs]
        self.known += [d is not None for d in docs]
        self.lengths += lengths.tolist()
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= GROUP * BLOCK:
            self._flush(self.size - self.size % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, n, GROUP * BLOCK):
            for block in encode_blocks(ids[i:min(n, i + GROUP * BLOCK)], self.share):
                self.out.write(block)
                self.starts.append(self.at)
                self.at += len(block)
        self.held, self.size = [ids[n:].copy()], len(ids) - n
        self.ids += n

    def close(self) -> tuple[str, int, int]:
        """File, documents and ids."""
        self._flush(self.size)
        for values, kind in ((self.starts, "<u8"), (self.docs, "<i8"), (self.known, "u1"), (self.lengths, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(_TRAILER.pack(self.at, len(self.starts), len(self.docs), self.ids, MAGIC))
        self.out.close()
        return self.uri, len(self.docs), self.ids


class IdReader:
    """One file: its documents, and the ids of any range of places."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _TRAILER.size)
        footer, n_blocks, n_docs, self.n_ids, magic = _TRAILER.unpack(self.file.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} holds no token ids")
        self.file.seek(footer)
        rest = self.file.read(size - _TRAILER.size - footer)
        self.starts = np.append(np.frombuffer(rest, "<u8", n_blocks), np.uint64(footer)).astype(np.int64)
        self.docs = np.frombuffer(rest, "<i8", n_docs, 8 * n_blocks)
        self.known = np.frombuffer(rest, "u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        lengths = np.frombuffer(rest, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from ``first`` to before ``last``."""
        starts = self.starts[first:last + 1]
        self.file.seek(int(starts[0]))
        return decode_blocks(self.file.read(int(starts[-1] - starts[0])), (starts[:-1] - starts[0]).tolist())

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at these places of the file: reads their blocks alone."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK:stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Pieces of documents: document number, place of the piece, ids; a group of blocks is held at a time."""
        for first in range(0, len(self.starts) - 1, GROUP):
            ids, at = self.blocks(first, min(first + GROUP, len(self.starts) - 1)), first * BLOCK
            doc = int(np.searchsorted(self.bounds, at, "right")) - 1
            while doc < len(self.docs) and self.bounds[doc] < at + len(ids):
                low, high = max(at, int(self.bounds[doc])), min(at + len(ids), int(self.bounds[doc + 1]))
                if high > low:
                    yield doc, low, ids[low - at:high - at]
                doc += 1

    def close(self) -> None:
        self.file.close()


class StringEncoder:
    """Token ids of texts, by the library, through the distinct strings between white space."""

    _loaded: dict[str, StringEncoder] = {}

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core to itself
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    @classmethod
    def of_worker(cls, vocabulary: str) -> StringEncoder:
        """The worker's own, with the strings of its earlier tasks."""
        if vocabulary not in cls._loaded:
            cls._loaded[vocabulary] = cls(vocabulary)
        return cls._loaded[vocabulary]

    def forget(self) -> None:
        """Code 0 is no string at all."""
        self.known: dict[str, int] = {"": 0}
        self.pool, self.used, self.chars = np.zeros(1 << 16, np.uint32), 0, 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def learn(self, strings: list[str]) -> None:
        """Encode strings that are not known yet."""
        code = len(self.known)
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while code + len(rows) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        self.pool[self.used:self.used + len(ids)] = ids
        self.first[code:code + len(rows)] = self.used + np.cumsum(size) - size
        self.count[code:code + len(rows)] = size
        self.used += len(ids)
        self.chars += sum(map(len, strings))
        self.known.update(zip(strings, range(code, code + len(rows))))

    def codes(self, strings: pa.Array) -> np.ndarray:
        """The code of each string; each distinct one is looked up once."""
        found = strings.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        for i in range(0, len(new), 4096):
            self.learn(new[i:i + 4096])
        codes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return codes[found.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the texts, and their ids one after another, each text with the end id."""
        if self.used > KNOWN_IDS or self.chars > 4 * KNOWN_IDS:
            self.forget()
        words = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        found = words.flatten().dictionary_encode()
        strings, index = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        # the library lowers letters itself; of plain strings the case is settled and a last full stop or comma taken
        # off here, so fewer strings differ (special tokens are told by case, and other letters are composed first)
        plain = pc.and_(pc.match_substring_regex(strings, PLAIN), pc.invert(pc.match_substring(strings, "<|")))
        strings = pc.if_else(plain, pc.utf8_lower(strings), strings)
        tail = pc.and_(plain, pc.match_substring_regex(strings, TAIL))
        stem = self.codes(pc.if_else(tail, pc.utf8_slice_codeunits(strings, 0, -1), strings))
        rest = self.codes(pc.if_else(tail, pc.utf8_slice_codeunits(strings, -1), ""))
        sequence = np.empty(2 * len(index) + len(ends), np.int64)
        at = 2 * ends + np.arange(len(ends))
        other = np.ones(len(sequence), bool)
        other[at] = False
        sequence[other] = np.stack([stem, rest], axis=1)[index].ravel()
        sequence[at] = 0
        size = self.count[sequence]
        size[at] = 1
        stop = np.cumsum(size)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint32)
        np.take(self.pool, np.repeat(self.first[sequence] - stop + size, size) + np.arange(len(ids)), out=ids, mode="clip")
        ids[stop[at] - 1] = end_id
        return np.diff(stop[at], prepend=0), ids


def write_ids(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *,
              end_id: int = 1, share: float = 0.98, docs_per_file: int = 20_000) -> DataFrame:
    """Encode the documents and write their ids to files in ``folder``; returns the manifest, a written table.

    Files follow one another by ``slice``, documents within them by id, null ids
    first; rows that share an id are ordered by a hash of their texts, and rows
    equal in both are alike.  Null and empty texts have the end id alone; texts
    of any length are whole; other columns are ignored; an empty table writes no
    file.  Ids are integers; ``vocabulary`` is a path on every executor, of a
    file whose tokens don't cross ASCII white space.  ``share`` is the
    percentile of a block's differences that its width holds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        task = TaskContext.get()
        encoder = StringEncoder.of_worker(vocabulary)
        writer = None
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in blocks(np.concatenate([[0], np.cumsum(size)]), TEXT_BYTES):
                if writer is None:
                    files, path = _open(folder)
                    files.create_dir(path, recursive=True)
                    writer = IdWriter(f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.pfor", share)
                lengths, ids = encoder.encode(texts.slice(i, j - i), end_id)
                writer.add(batch.column(0).slice(i, j - i).to_pylist(), lengths, ids)
        if writer is not None:
            uri, n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([uri]),
                                              pa.array([n_docs]), pa.array([n_ids])], names=["slice", "file", "n_docs", "n_ids"])

    # a row number of no order spreads equal rows of one id over the ranges
    keyed = rows.select("id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ranged = keyed.repartitionByRange(tasks_for(rows.count(), docs_per_file), "id", "_hash", "_row")
    return written(ranged.sortWithinPartitions("id", "_hash", "_row").select("id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32, file, first.

    ``start`` counts the ids of all documents before, ``first`` those in the same
    file; ``ids_crc32`` is the unsigned crc32 of the ids as little-endian
    unsigned 32-bit numbers.  A file is read a group of blocks at a time.
    """
    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = IdReader(uri)
                check = np.zeros(len(reader.docs), np.uint32)
                for doc, _, ids in reader.documents():
                    check[doc] = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), int(check[doc]))
                reader.close()
                columns = [pa.array(reader.docs, mask=~reader.known), pa.array(reader.bounds[:-1] + base),
                           pa.array(np.diff(reader.bounds)), pa.array(check.astype(np.int64)),
                           pa.array([uri] * len(check), pa.string()), pa.array(reader.bounds[:-1])]
                table = pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "first"])
                for i in range(0, table.num_rows, 10_000):
                    yield table.slice(i, 10_000)

    placed = running_by_group(manifest, [], ["slice"], {"stop": ("sum", "n_ids")})
    files = written(placed.select("file", (F.col("stop") - F.col("n_ids")).alias("base")), "files")
    # a file a task: names are so short that adaptive execution would put all of them into one
    return files.repartition(max(1, files.count())).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, first long")


def round_trip(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write the ids of the documents (in the scratch folder by default) and read them back."""
    return read_ids(write_ids(docs, vocabulary, folder or scratch_path(docs.sparkSession, "ids"), **options))
