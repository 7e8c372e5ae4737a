"""Operator 7. SentencePiece encoding and decoding by a merge-type prefix table.

A byte-pair segmentation of a prefix of a text ends in one token only. For every prefix the table stores that token: of
the pieces that an automaton finds to end there, the one whose predecessor (the last token of the prefix before it) is
compatible with it, that is, the two side by side would not have merged across their border. Ids are then recovered
backwards from the end of the table. The compatibility of two pieces follows from the order of merges along the right edge
of the first and the left edge of the second.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import CACHED_LENGTH, bounded_batches, claim

SPACE = "▁"  # the mark that stands for a space
# Fixed values of the model format's piece types.
NORMAL, CONTROL, BYTE = 1, 3, 6
FOREVER = 1 << 62


class PieceCodec:
    """Encodes and decodes exactly as the sentencepiece library does for a BPE model with byte fallback, identity
    normalisation and a dummy prefix (others are refused). limit bounds each cache; a full cache starts anew."""

    def __init__(self, path: str, bos: bool = True, eos: bool = True, limit: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("this model needs another normaliser or segmenter")
        self.limit = limit
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        order = sorted(self.ids.values(), key=lambda k: -model.pieces[k].score)
        self.rank = dict(zip(order, range(len(order)), strict=True))
        self.names = [p.piece for p in model.pieces]
        byte_ids = [k for k, p in enumerate(model.pieces) if p.type == BYTE]
        self.byte_id = {int(self.names[k][3:5], 16): k for k in byte_ids}
        self.content = [b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        for value, k in self.byte_id.items():
            self.content[k] = bytes([value])
        self.content[train.unk_id] = train.unk_surface.encode()
        self.packed = [k.to_bytes(4, "little") for k in range(len(self.names))]
        self.unk_id = train.unk_id
        self.head = np.array([train.bos_id] if bos else [], "<u4").tobytes()
        self.tail = np.array([train.eos_id] if eos else [], "<u4").tobytes()
        self.automaton = None
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _prepare(self) -> None:
        """What only encoding needs, built when first used."""
        import ahocorasick

        #: Pairs of characters inside pieces: a merge can cross no other pair.
        self.inner = {pair for x in self.ids for pair in zip(x, x[1:], strict=False)}
        #: Cutting before a space mark is exact only if no piece has one after another character.
        self.by_space = not any(SPACE in x.lstrip(SPACE) for x in self.ids)
        self.edges: dict[int, tuple[list, list]] = {}
        self.automaton = ahocorasick.Automaton()
        self.monotone = True
        for name, k in self.ids.items():
            tree = self._derive(name)
            if tree is None:  # merging its own characters doesn't end in it, so no text's segmentation holds it
                continue
            self.edges[k] = (self._edge(tree, 2), self._edge(tree, 1))
            self.automaton.add_word(name, (k, len(name)))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[tuple]:
        """Plain pairwise merging: trees (piece id or None, left, right, name)."""
        nodes = [(self.ids.get(c), None, None, c) for c in text]
        before, after = list(range(-1, len(nodes) - 1)), list(range(1, len(nodes) + 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(nodes) and (k := self.ids.get(nodes[i][3] + nodes[j][3])) is not None:
                heapq.heappush(heap, (self.rank[k], i, j, nodes[i][3], nodes[j][3]))

        for i in range(len(nodes) - 1):
            offer(i, i + 1)
        gone = set()
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if i in gone or j in gone or after[i] != j or nodes[i][3] != a or nodes[j][3] != b:
                continue
            nodes[i] = (self.ids[a + b], nodes[i], nodes[j], a + b)
            gone.add(j)
            after[i] = after[j]
            if after[i] < len(nodes):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for i, x in enumerate(nodes) if i not in gone]

    def _derive(self, name: str) -> tuple | None:
        out = self._merge(name)
        return out[0] if len(out) == 1 else None

    def _edge(self, tree: tuple, side: int) -> list[tuple[str, int, int]]:
        """Nodes along an edge of a tree: name, time made, time merged away. Times are ranks; a character is there from -1."""
        out, end = [], FOREVER
        while tree is not None:
            made = self.rank[tree[0]] if tree[1] is not None else -1
            if made >= end:
                self.monotone = False
            out.append((tree[3], made, end))
            end, tree = made, tree[side]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b side by side stay as they are. Of merges at the same time the left one comes first."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2 * self.limit:
                self.pairs.clear()
            if self.monotone:
                known = True
                for x, made_x, end_x in self.edges[a][0]:
                    for y, made_y, end_y in self.edges[b][1]:
                        if made_y < end_x and made_x <= end_y and (z := self.ids.get(x + y)) is not None and self.rank[z] < end_x and self.rank[z] <= end_y:
                            known = False
                            break
                    if not known:
                        break
            else:
                known = [x[0] for x in self._merge(self.names[a] + self.names[b])] == [a, b]
            self.pairs[key] = known
        return known

    def _unit(self, unit: str) -> bytes:
        """Ids of a run of characters that merges can cross, by the prefix table."""
        n = len(unit)
        if n == 1:
            k = self.ids.get(unit)
            return self.packed[k] if k is not None else b"".join([self.packed[self.byte_id[x]] for x in unit.encode()])
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [0] * (n + 1)
        known, pairs, packed = last, self.pairs, self.packed
        for end, (k, length) in self.automaton.iter(unit):
            end += 1
            if known[end] < 0:
                start = end - length
                if start == 0:
                    known[end], size[end] = k, length
                elif (p := known[start]) >= 0:
                    ok = pairs.get(p << 20 | k)
                    if self.compatible(p, k) if ok is None else ok:
                        known[end], size[end] = k, length
        out = []
        while n:
            out.append(packed[last[n]])
            n -= size[n]
        return b"".join(out[::-1])

    def _chunk(self, key: str) -> bytes:
        """Ids of the space mark and key after it."""
        text, inner, lo, out = SPACE + key, self.inner, 0, []
        cuts = [k for k, pair in enumerate(zip(text, key, strict=False), 1) if pair not in inner]
        for hi in [*cuts, len(text)]:
            unit = text[lo:hi]
            ids = self.units.get(unit)
            if ids is None:
                ids = self._unit(unit)
                if len(unit) <= CACHED_LENGTH:
                    self.units[unit] = ids
            out.append(ids)
            lo = hi
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, with the begin and end ids asked for."""
        if not text:
            return self.head + self.tail
        if self.automaton is None:
            self._prepare()
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        if len(self.units) > self.limit:
            self.units.clear()
        if not self.by_space:
            keys = [text.replace(" ", SPACE)]
        elif "  " in text or SPACE in text or text[0] == " ":
            keys = [x[1:] for x in re.split(f"(?<=[^{SPACE}])(?={SPACE})", SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.split(" ")
        chunks = self.chunks
        try:
            return b"".join([self.head, *map(chunks.__getitem__, keys), self.tail])
        except KeyError:
            new = set(keys).difference(chunks)
            for key in new:
                chunks[key] = self._chunk(key)
            out = b"".join([self.head, *map(chunks.__getitem__, keys), self.tail])
            for key in new:
                if len(key) > CACHED_LENGTH:
                    del chunks[key]
            return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, as the library's decode(ids): the dummy prefix's space goes, bytes that are no UTF-8 become U+FFFD."""
        known = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.content.__getitem__, known))
        for k in known:
            if self.content[k]:
                if raw[:1] == b" " and not self.is_byte[k] and k != self.unk_id:
                    raw = raw[1:]
                break
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(known)

    def _decode_broken(self, known: list[int]) -> str:
        """Runs of byte ids: each byte that starts no whole character becomes U+FFFD."""
        out, run = [], b""
        for k in [*known, -1]:
            if k >= 0 and self.is_byte[k]:
                run += self.content[k]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if k >= 0:
                piece = self.content[k].decode()
                out.append(piece[1:] if not "".join(out) and piece[:1] == " " and k != self.unk_id else piece)
        return "".join(out)


_codecs: dict[tuple, PieceCodec] = {}


def codec(path: str, bos: bool, eos: bool) -> PieceCodec:
    """One codec for each worker process."""
    key = (path, bos, eos)
    claim("pieces", _codecs.clear)
    if key not in _codecs:
        _codecs[key] = PieceCodec(path, bos, eos)
    return _codecs[key]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """docs with out_col: the ids of the whole text as little-endian unsigned 32-bit integers (binary).

    A null or empty text has the begin and end ids only. Other columns stay as they are; one named out_col is replaced.
    One pass, no shuffle. Rows repeat as they do in docs.
    """
    rest = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, bos, eos)
        for whole in batches:
            for batch in _slices(whole):
                ids = [c.encode(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                yield batch.append_column(out_col, pa.array(ids, pa.binary()))

    return bounded_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.BinaryType())]))


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the text of ids_col. Null ids give a null text; other columns stay as they are."""
    rest = rows.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, True, True)
        for whole in batches:
            for batch in _slices(whole):
                ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
                yield batch.append_column(out_col, pa.array([None if x is None else c.decode(x) for x in ids], pa.string()))

    return bounded_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encode_pieces() and decode_pieces() of its ids, with begin and end ids, by one worker in one pass. Null and empty texts
    have the two ids and decode to an empty text; very long texts go whole; rows repeat as in docs; columns named as the
    results give way to them, all others stay; an empty table gives no rows."""
    rest = docs.drop(ids_col, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, True, True)
        for whole in batches:
            for batch in _slices(whole):
                ids = [c.encode(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                batch = batch.append_column(ids_col, pa.array(ids, pa.binary()))
                yield batch.append_column(out_col, pa.array(list(map(c.decode, ids)), pa.string()))

    fields = [T.StructField(ids_col, T.BinaryType()), T.StructField(out_col, T.StringType())]
    return bounded_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, *fields]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's round trip (see round_trip); null ids stay null."""
    return round_trip(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded with begin and end ids, then decoded."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
