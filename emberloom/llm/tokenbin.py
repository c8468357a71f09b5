"""Token ids in fixed-width bit-packed files, with block offsets for random access.

Documents are range-partitioned and sorted by ``doc_id``; every partition becomes one file or more, and the files
in the order of their first ``doc_id`` (and, of one partition, their number) hold all ids in ascending document
order. Each id takes the least number of bits that the vocabulary needs. A file is a row of blocks and a footer::

    block   "EMTB" | bits u8 | n_docs u32 | n_ids u64 | doc_id i64 * n_docs | n_tokens u32 * n_docs | packed ids
    footer  "EMTF" | n_blocks u32 | block offset u64 * n_blocks | first id of block u64 * n_blocks
            | first doc_id i64 | n_ids u64 | file number u32 | footer length u32 | "EMTE"

and one line end follows each block and the footer, as Spark's text writer puts it there; it writes the bytes as
they are to any file system that Spark can reach. Ids are packed with the lowest bit first, so that numpy packs
and unpacks a block at once, and a reader finds any document by the footer's offsets.

The writer starts a new file every ``FILE_RECORDS`` records. A file that has reached ``FILE_BYTES`` before is filled
up with empty records, which take a line end each, so that no file grows with a partition: it has ``FILE_BYTES`` and
one block at most, and a block ``BLOCK_IDS`` ids and one document at most.

Encoding memoises words: the tokenizer drops white space and never joins over it, so a text is the sequence of
its words cut at ASCII white space. The memo is bounded.

Defined cases: a null text counts as empty and holds the end id alone; null ``doc_id`` sorts first and stays
null on reading; repeated ``doc_id`` rows each have a row, ordered by their text; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import scratch
from emberloom.llm.bpe import blocks, no_collection, sizes

MEMO_ROWS = 500_000
BLOCK_IDS = 1 << 18
BLOCK_CHARS = 2_000_000
FILE_RECORDS = 1_000
FILE_BYTES = 128 << 20
#: Stands for a null doc_id in a block.
NO_ID = -(2**63)
_HEAD, _FOOT, _END = "<4sBIQ", "<4sI", "<qQII4s"
_HEAD_BYTES, _FOOT_BYTES, _END_BYTES = (struct.calcsize(x) for x in (_HEAD, _FOOT, _END))
#: Marks that may follow a letter or digit; the tokenizer always cuts before them. Fixed values.
_MARKS = b".,!?;:$%&*#|()"


def bits_for(vocab_size: int) -> int:
    """Least number of bits that hold every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first; the last byte is padded with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    rows = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` on, without unpacking what stands before them."""
    if bits in (8, 16):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    begin, end = first * bits, (first + count) * bits
    some = np.frombuffer(data, dtype=np.uint8)[begin // 8 : -(-end // 8)]
    flags = np.unpackbits(some, bitorder="little")[begin % 8 : begin % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class WordCoder:
    """Encodes texts with a tokenizer of the tokenizers library, word by word, with a bounded memo."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _library(self, words: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in made]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct lower-case words. Marks behind a letter or digit are encoded apart from it; a word of
        the letters a to z is one piece to the model, and all others go through the whole tokenizer."""
        cores, cut = {}, {}
        for w in words:
            core = w.rstrip(_MARKS)
            if core and core != w and core.decode()[-1].lower()[-1].isalpha():
                cut[w] = (core, w[len(core) :])
                cores[core] = cores[w[len(core) :]] = None
            else:
                cores[w] = None
        other = []
        for w in cores:
            known = self.memo.get(w)
            if known is not None:
                cores[w] = known
            elif w.isalpha() and w.isascii():
                cores[w] = np.array([t.id for t in self.model.tokenize(w.decode())], dtype="<u4").tobytes()
            else:
                other.append(w)
        cores.update(zip(other, self._library(other), strict=True))
        return {w: cores[cut[w][0]] + cores[cut[w][1]] if w in cut else cores[w] for w in words}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get, fresh, again, out = self.memo.get, set(), [], []
        for i, text in enumerate(texts):
            if "<|" in text:  # may hold the tokenizer's own tokens, which are told by their case
                out.append(self._library([text.encode()])[0])
                continue
            words = text.encode().lower().split()
            found = list(map(get, words))
            if None in found:
                fresh.update([w for w, x in zip(words, found, strict=True) if x is None])
                again.append((i, words, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if fresh:
            made = self._words(list(fresh))
            for i, words, found in again:  # a word without ids is known, too
                out[i] = b"".join([made[w] if x is None else x for w, x in zip(words, found, strict=True)])
            if (room := MEMO_ROWS - len(self.memo)) > 0:
                self.memo.update(itertools.islice(made.items(), room))
        return out


_coders: dict[str, WordCoder] = {}


def _coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders.clear()
        _coders[path] = WordCoder(path)
    return _coders[path]


def _block(doc_ids: list, ids: list[bytes], bits: int) -> tuple[bytes, int]:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    head = struct.pack(_HEAD, b"EMTB", bits, len(ids), len(flat))
    names = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    return head + names + np.array([len(x) // 4 for x in ids], dtype="<u4").tobytes() + pack(flat, bits), len(flat)


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id``, and write the files in ascending ``doc_id`` order."""

    def run(batches):
        coder = _coder(tokenizer_path)
        bits, end = bits_for(coder.vocab_size), int(end_id).to_bytes(4, "little")
        file = _File(bits, file_records, file_bytes)
        kept_docs, kept_ids, kept = [], [], 0
        with no_collection():
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                    texts = [t or "" for t in batch.column(1)[part].to_pylist()]
                    for doc_id, ids in zip(doc_ids[part], coder.encode(texts), strict=True):
                        kept_docs.append(doc_id)
                        kept_ids.append(ids + end)
                        kept += len(ids) // 4 + 1
                        if kept >= block_ids:
                            yield _records([file.block(kept_docs, kept_ids)])
                            kept_docs, kept_ids, kept = [], [], 0
                            if file.full():
                                yield _records(file.close(fill=True))
                                file = _File(bits, file_records, file_bytes, file.number + 1)
            if kept_docs:
                yield _records([file.block(kept_docs, kept_ids)])
            if file.offsets:
                yield _records(file.close())

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    packed = ordered.mapInArrow(run, "data binary")
    lines = packed.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n")
    lines.option("maxRecordsPerFile", file_records).text(path)


class _File:
    """Offsets and sums of the file that a task is writing."""

    def __init__(self, bits: int, most_records: int, most_bytes: int, number: int = 0):
        self.bits, self.most_records, self.most_bytes, self.number = bits, most_records, most_bytes, number
        self.offsets: list[int] = []
        self.firsts: list[int] = []
        self.total = self.place = 0
        self.first_doc = NO_ID

    def block(self, doc_ids: list, ids: list[bytes]) -> bytes:
        data, n = _block(doc_ids, ids, self.bits)
        if not self.offsets and doc_ids[0] is not None:
            self.first_doc = doc_ids[0]
        self.offsets.append(self.place)
        self.firsts.append(self.total)
        self.total, self.place = self.total + n, self.place + len(data) + 1
        return data

    def full(self) -> bool:
        return len(self.offsets) >= self.most_records - 1 or self.place >= self.most_bytes

    def close(self, fill: bool = False) -> list[bytes]:
        """The last records: empty ones, where the writer has to start another file behind, and the footer."""
        foot = struct.pack(_FOOT, b"EMTF", len(self.offsets)) + np.array(self.offsets, "<u8").tobytes() + np.array(self.firsts, "<u8").tobytes()
        foot += struct.pack(_END, self.first_doc, self.total, self.number, len(foot) + _END_BYTES, b"EMTE")
        return [b""] * ((self.most_records - 1 - len(self.offsets)) * fill) + [foot]


def _records(data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["data"])


def read_block(data: bytes, offset: int) -> tuple[np.ndarray, np.ndarray, bytes, int, int]:
    """(doc_ids, n_tokens, packed ids, bits, length) of the block at ``offset``."""
    magic, bits, n_docs, n_ids = struct.unpack_from(_HEAD, data, offset)
    if magic != b"EMTB":
        raise ValueError(f"no block at {offset}")
    at = offset + _HEAD_BYTES
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lens = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    body = at + 12 * n_docs
    return doc_ids, lens, data[body : body + -(-n_ids * bits // 8)], bits, int(n_ids)


def read_footer(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(block offsets, first id of each block, first doc_id, number of ids) of a whole file or its tail."""
    first_doc, n_ids, _, length, magic = struct.unpack_from(_END, data, len(data) - 1 - _END_BYTES)
    if magic != b"EMTE":
        raise ValueError("no footer")
    at = len(data) - 1 - length
    n = struct.unpack_from(_FOOT, data, at)[1]
    at += _FOOT_BYTES
    return np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n), first_doc, n_ids


def read_document(data: bytes, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a file, by its footer's offsets; None where it isn't there."""
    for offset in read_footer(data)[0].tolist():
        doc_ids, lens, packed, bits, _ = read_block(data, offset)
        found = np.flatnonzero(doc_ids == doc_id)
        if len(found):
            return unpack(packed, bits, int(lens[: found[0]].sum()), int(lens[found[0]]))
    return None


_TAIL = "file string, first_doc long, n_ids long, number long"
_ROWS = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    A first, small pass takes the last bytes of each file; the running sum over files (one row each) gives the
    number of ids before a file. The second unpacks the blocks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def tails(batches):
        for batch in batches:
            ends = [struct.unpack_from(_END, x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([e[i] for e in ends], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["file", "first_doc", "n_ids", "number"])

    def rows(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                offsets, firsts, _, _ = read_footer(data)
                for offset, first in zip(offsets.tolist(), firsts.tolist(), strict=True):
                    doc_ids, lens, packed, bits, n_ids = read_block(data, offset)
                    raw = unpack(packed, bits, 0, n_ids).astype("<u4").tobytes()
                    ends = np.cumsum(lens, dtype=np.int64)
                    starts = ends - lens
                    crcs = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(lens)), pa.array(doc_ids.copy(), mask=doc_ids == NO_ID), pa.array(starts + first), pa.array(lens.astype(np.int64)), pa.array(crcs, pa.int64())],
                        names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                    )

    tail = files.where("length > 0").select("path", F.expr(f"substring(content, length - {_END_BYTES}, {_END_BYTES})").alias("tail"))
    before = 0
    starts = []
    for r in sorted(tail.mapInArrow(tails, _TAIL).collect(), key=lambda r: (r.first_doc, r.number)):  # a row for each file; one doc_id is in one partition
        starts.append((r.file, before))
        before += r.n_ids
    known = spark.createDataFrame(starts, "file string, before long")
    parsed = files.where("length > 0").select("path", "content").mapInArrow(rows, _ROWS)
    return parsed.join(known, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def offsets_and_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files to the shared scratch folder and read them back."""
    spark = docs.sparkSession
    path = scratch.new_path(spark, "tokens")
    write_files(docs, path, tokenizer_path, end_id)
    return read_files(spark, path)
