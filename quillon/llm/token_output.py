"""Operator 1. Token-ID / binary output: seekable zstandard shards of token ids.

A shard holds one independent zstandard frame for each document (more for a document beyond frame_ids ids), then a
skippable frame with the documents' table, then the seek table of the zstandard seekable format: compressed size,
decompressed size and checksum (low 32 bits of XXH64 of the content) of every frame. A reader finds a document by the two
tables at the end and decompresses its frames only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import bounded_batches, claim, filesystem, shared_dir

# Fixed values of the zstandard seekable format.
SKIPPABLE_DOCUMENTS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frames", "<u4"), ("n_tokens", "<u8")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


#: Longer parts of texts, in bytes, don't stay in a worker's cache, so that its size is bounded.
CACHED_LENGTH = 1000


class ShardWriter:
    """Writes documents' ids to one shard, frame by frame; holds one document and the tables only."""

    def __init__(self, out, level: int = 1, frame_ids: int = 1 << 20):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        step = 4 * self.frame_ids
        parts = [ids[i : i + step] for i in range(0, len(ids), step)] or [b""]
        for part in parts:
            packed = self.packer.compress(part)
            self.out.write(packed)
            self.entries.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.documents.append((doc_id or 0, doc_id is None, len(parts), len(ids) // 4))

    def close(self) -> None:
        table = self.packer.compress(np.array(self.documents, _DOCUMENT).tobytes())
        skippable = struct.pack("<II", SKIPPABLE_DOCUMENTS, len(table)) + table
        self.out.write(skippable)
        self.entries.append((len(skippable), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class ShardReader:
    """Random access to a shard: file is a seekable binary file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of this file")
        file.seek(size - 9 - 12 * count)
        self.entries = np.frombuffer(file.read(12 * count), _ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()
        file.seek(int(self.offsets[-2]))
        table = file.read(int(self.entries["packed"][-1]))[8:]
        self.documents = np.frombuffer(self.unpacker.decompress(table), _DOCUMENT)
        self.first = np.concatenate([[0], np.cumsum(self.documents["frames"], dtype=np.int64)])

    def read(self, at: int) -> bytes:
        """The ids of the at-th document of the shard; decompresses its frames only and checks them."""
        lo, hi = int(self.first[at]), int(self.first[at + 1])
        self.file.seek(int(self.offsets[lo]))
        raw, out, k = self.file.read(int(self.offsets[hi] - self.offsets[lo])), [], 0
        for packed, size, checksum in self.entries[lo:hi].tolist():
            part = self.unpacker.decompress(raw[k : k + packed], max_output_size=size) if size else b""
            if len(part) != size or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {lo} of the shard is damaged")
            out.append(part)
            k += packed
        return b"".join(out)

    def find(self, doc_id: int) -> int:
        """Position of a document (null ids stand first, then documents in ascending order)."""
        nulls = int(self.documents["null"].sum())
        at = nulls + int(np.searchsorted(self.documents["doc_id"][nulls:], doc_id))
        if at == len(self.documents) or self.documents["doc_id"][at] != doc_id:
            raise KeyError(doc_id)
        return at


#: Kinds of bytes by what the pre-tokenizer makes of their character. 0 stands for what is not told from one byte.
_SPACE, _BREAK, _LETTER, _DIGIT, _MARK, _QUOTE, _LEAD, _DOUBTFUL = range(1, 9)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = _MARK
    for x in range(33, 127):
        if chr(x).isalnum():
            kind[x] = _DIGIT if chr(x).isdigit() else _LETTER
    kind[ord("'")], kind[32], kind[[9, 10, 13]] = _QUOTE, _SPACE, _BREAK
    # First bytes of longer characters; among those of four first bytes are some that are white space.
    kind[0xC3:0xF5], kind[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD, _DOUBTFUL
    return kind


def _pairs() -> np.ndarray:
    """For kinds a, b of neighbouring bytes, at 16 * a + b: 1 if texts are cut between them, 2 if before a."""
    pair = np.zeros((16, 16), np.uint8)
    seen = [_LETTER, _DIGIT, _MARK, _QUOTE]
    for a in seen:
        pair[a, [_SPACE, _BREAK]] |= 1
    pair[[_SPACE, _BREAK], _LETTER : _LEAD + 1] |= 2
    pair[_BREAK, _LETTER : _LEAD + 1] |= 1
    for a in (_LETTER, _DIGIT):
        pair[a, [_MARK, _QUOTE]] |= 1
        pair[_MARK, a] |= 1
    pair[_LETTER, _DIGIT] |= 1
    pair[_DIGIT, _LETTER] |= 1
    return pair.ravel()


_KINDS, _PAIRS = _kinds(), _pairs()
#: First bytes of two whose characters are all letters; C3 has two that are none.
_LATIN = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where parts begin in raw, the UTF-8 bytes of texts that begin at starts (ascending): at places where a byte-level
    pre-tokenizer's tokens begin, whatever else is in the text.

    A token of letters, of digits or of other characters, each with a space before it at most, ends where the kind changes
    (an apostrophe may begin a token of letters, so none is cut off from what follows). Of a run of white space the last
    character goes with what follows if it is a space and is a token if it is none, and the others are a token; at the end
    of a text the whole run is one. Characters whose kind is not known here are not cut from what stands beside them.
    """
    if not len(raw):
        return np.empty(0, np.int64)
    kind = _KINDS[raw]
    high = np.flatnonzero(kind >= _LEAD)
    if len(high):
        lead, second = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
        letters = high[_LATIN[lead] & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))]
        kind[letters] = kind[letters + 1] = _LETTER
        doubtful = kind[high] == _DOUBTFUL
        if doubtful.any():
            at, lead, second = high[doubtful], lead[doubtful], second[doubtful]
            third = raw[np.minimum(at + 2, len(raw) - 1)]
            # U+0085, U+00A0; U+1680; U+2000 to 200A, 2028, 2029, 202F, 205F; U+3000.
            space = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (lead == 0xE1) & (second == 0x9A) | (lead == 0xE3) & (second == 0x80) & (third == 0x80)
            space |= (lead == 0xE2) & ((second == 0x81) | (second == 0x80) & ((third < 0x90) | (third >= 0xA8)))
            kind[at] = np.where(space, 0, _LEAD)
    bits = _PAIRS[(kind[:-1] << 4) | kind[1:]]
    starts = starts[starts < len(raw)]
    bits[starts[starts > 0] - 1] = 0
    here = np.zeros(len(raw), bool)
    here[1:] = bits & 1
    here[:-1] |= bits > 1
    here[starts] = True
    return np.flatnonzero(here)


class CachedEncoder:
    """Whole texts to ids by the tokenizers library, which sees each distinct part of a text once.

    Texts are cut into parts where tokens begin for certain (cuts), the distinct parts of a batch are looked up, and the
    parts' ids are put together by columns. limit bounds the cache: a full one keeps what several batches held, half the
    limit at most; parts beyond CACHED_LENGTH go with the next batch. Texts that hold one of the tokenizer's own tokens go to
    the library as they are: it gives the token's id.
    """

    _one_kind = r"^ ?(?:[0-9]+|[!-/:-@\[-`{-~]+)$"

    def __init__(self, path: str, limit: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        self.alphabet = np.arange(256, dtype="<u2")
        others = [x for x in range(256) if x not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
        self.alphabet[others] = 256 + np.arange(len(others))
        self.alphabet[10] = 10
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for x, k in vocabulary.items():
            self.lengths[k] = len(x)
        #: Known parts, and how many batches held them; the ids of part k are values[starts[k] : starts[k + 1]].
        self.parts, self.uses, self.long = pa.array([], pa.large_string()), np.empty(0, np.int64), False
        self.values, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _trim(self) -> None:
        if len(self.parts) <= self.limit and not self.long:
            return
        keep = pc.binary_length(self.parts).to_numpy() <= CACHED_LENGTH
        if len(self.parts) > self.limit:
            at = len(self.parts) - max(1, self.limit // 2)
            keep &= self.uses > max(1, np.partition(self.uses, at)[at])
            self.uses //= 2
        mask = pa.array(keep)
        lists = pa.LargeListArray.from_arrays(self.starts, pa.array(self.values)).filter(mask)
        self.parts, self.uses, self.long = self.parts.filter(mask), self.uses[keep], False
        self.values, self.starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])

    def _library(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts, and how many each has. Letters, digits or ASCII marks with a space or none before them are one
        token group of the pre-tokenizer: the library gets them in its byte alphabet, many in a text, and byte counts part
        their ids. All else goes through its own pre-tokenizer."""
        letters = pc.utf8_is_alpha(pc.if_else(pc.starts_with(parts, " "), pc.utf8_slice_codeunits(parts, 1), parts))
        single = pc.or_(letters, pc.match_substring_regex(parts, self._one_kind))
        plain, rest = parts.filter(single), parts.filter(pc.invert(single)).to_pylist()
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(plain), 20_000):
            some = plain.slice(k, 20_000)
            lines = pc.binary_join_element_wise(some, pa.scalar("", some.type), pa.scalar("\n", some.type))
            raw = np.frombuffer(lines.buffers()[2], np.uint8, pc.sum(pc.binary_length(lines)).as_py())
            mapped = self.alphabet[raw].tobytes().decode("utf-16-le")
            found = np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[found]), np.cumsum(pc.binary_length(some).to_numpy())) + 1
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        for k in range(0, len(rest), 20_000):
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(rest[k : k + 20_000], add_special_tokens=False)]
            ids += found
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        back = np.empty(len(parts), np.int64)
        back[np.concatenate([np.flatnonzero(single), np.flatnonzero(pc.invert(single))])] = np.arange(len(parts))
        every, sizes = np.concatenate(ids), np.concatenate(sizes)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(every)).take(pa.array(back))
        return lists.flatten().to_numpy(), sizes[back]

    def _numbers(self, keys: pa.Array) -> np.ndarray:
        """Numbers of distinct parts."""
        self._trim()
        at = pc.fill_null(pc.index_in(keys, value_set=self.parts), -1).to_numpy().astype(np.int64)
        holes = np.flatnonzero(at < 0)
        if len(holes):
            new = keys.take(pa.array(holes))
            ids, sizes = self._library(new)
            at[holes] = np.arange(len(self.parts), len(self.parts) + len(holes))
            self.parts = pa.concat_arrays([self.parts, new])
            self.uses = np.concatenate([self.uses, np.zeros(len(holes), np.int64)])
            self.long = pc.max(pc.binary_length(new)).as_py() > CACHED_LENGTH
            self.values = np.concatenate([self.values, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.uses[at] += 1
        return at

    def encode(self, texts: pa.Array | Sequence[str], end: bytes = b"") -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none), end appended. Texts of some millions of characters at
        a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        out = [end] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes() + end
        if whole.any():
            texts = texts.filter(pa.array(~whole))
        if not len(texts):
            return out
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return out
        data, offsets = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]
        at = cuts(np.frombuffer(data, np.uint8), offsets[:-1])
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, offsets[-1])), data).dictionary_encode()
        numbers = self._numbers(words.dictionary)[words.indices.to_numpy()]
        sizes = np.diff(self.starts)[numbers]
        ids = pa.LargeListArray.from_arrays(self.starts, pa.array(self.values)).take(pa.array(numbers))
        raw = ids.flatten().to_numpy().astype("<u4", copy=False)
        borders = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, offsets)].tolist()
        for k, lo, hi in zip(np.flatnonzero(~whole).tolist(), borders, borders[1:], strict=False):
            out[k] = raw[lo:hi].tobytes() + end
        return out


_encoders: dict[str, CachedEncoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 1, frame_ids: int = 1 << 20, shards: int | None = None) -> DataFrame:
    """Write each document's ids to seekable shards under path, in ascending id order over all shards.

    Returns the shards' index: shard int, file string, documents long, tokens long. It is itself written next to the
    shards (index/), by Spark's commit protocol, so of several attempts of a task the readers see one. A null text is
    empty (end_id only); null ids come first; equal ids stand in order of their text's hash; other columns of docs don't
    matter. An empty table gives no shard. shards: how many (about; some may be empty), by the size of docs; else as many as
    the session's shuffle partitions, or fewer.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_output", _encoders.clear)
        if tokenizer not in _encoders:
            _encoders[tokenizer] = CachedEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        shard = TaskContext.get().partitionId()
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        writer = out = None
        for batch in batches:
            if out is None:
                fs, base = filesystem(path)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{file}", compression=None)
                writer = ShardWriter(out, level, frame_ids)
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1), end), strict=True):
                writer.add(doc_id, tokens)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "documents": [len(writer.documents)], "tokens": [sum(x[3] for x in writer.documents)]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = ["id", F.xxhash64("text")]
    ordered = (rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)).sortWithinPartitions(F.col("id").asc_nulls_first(), keys[1], "text")
    bounded_batches(ordered).mapInArrow(write, "shard int, file string, documents long, tokens long").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_tokens(index: DataFrame, path: str) -> DataFrame:
    """Read shards back: doc_id, shard, position, start (ids of all documents before it), n_tokens, ids binary (little-endian
    unsigned 32-bit). One task reads a shard; a document at a time is in memory."""
    total = index.groupBy("shard", "file").agg(F.sum("tokens").alias("tokens"))
    # A row for each shard, thousands at most for 100 TB: the running sum is over these only.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = total.select("shard", "file", before.cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = filesystem(path)
                with fs.open_input_file(f"{base}/{row['file']}") as file:
                    reader, rows, size, start = ShardReader(file), [], 0, row["base"]
                    for at, (doc_id, null, _, n) in enumerate(reader.documents.tolist()):
                        ids = reader.read(at)
                        rows.append((None if null else doc_id, row["shard"], at, start, n, ids))
                        start, size = start + n, size + len(ids)
                        if size > 16_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return shards.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism * 4), "shard").mapInArrow(read, READ_SCHEMA)


READ_SCHEMA = "doc_id long, shard int, position long, start long, n_tokens long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "shard", "position", "start", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_document(index_row: dict, path: str, doc_id: int) -> np.ndarray:
    """One document's ids from its shard, without reading the rest."""
    fs, base = filesystem(path)
    with fs.open_input_file(f"{base}/{index_row['file']}") as file:
        reader = ShardReader(file)
        return np.frombuffer(reader.read(reader.find(doc_id)), "<u4")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards."""
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Two shards for each split of the input, so a shard's size doesn't grow with the table.
    shards = max(2 * docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    index = write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shards=shards)
    return read_tokens(index, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
