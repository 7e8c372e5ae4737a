from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillon.llm import token_output as t
from quillon.llm.shared import filesystem, shared_dir

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", "\n x", " \n y", "a   \n\n  b c", "x ", "<|endoftext|> hi<|endoftext|>", "a  b c", "don't. it's, x", "é, ñ. Ⅷ, ².", "a.b. c, d,. e.\n\nF.\nG ,\nH 3.\n4 5,\nQ", "\x01a b", "日本語。\nテスト 😀, x", "x" * 5000, "Word, word. " * 2000]


def expected(texts):
    lib = Tokenizer.from_file(PATH)
    return [np.array(lib.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for x in texts]


def test_encoder_equals_the_library():
    c = t.CachedEncoder(PATH, limit=3)
    end = (2).to_bytes(4, "little")
    assert c.encode(TEXTS, end) == expected(TEXTS)
    assert c.encode(TEXTS[::-1], end) == expected(TEXTS[::-1])
    assert c.encode([], end) == [] and c.encode(["", ""], end) == [end, end]
    assert 50256 in np.frombuffer(c.encode(["a <|endoftext|> b"])[0], "<u4")  # the library's own token for its literal


def test_random_texts_equal_the_library():
    r, c = random.Random(5), t.CachedEncoder(PATH, limit=200)
    alpha = ["the", "Of", " ", "  ", "\n", "\t", ".", ",", "é", "ñ", "日本", "😀", "'s", "12", "\u00a0", "\u3000", "\x01", "\x1c", "ⅷ", "²", "ª", "-", "<|endoftext|>", "ͅ", "ǅ", "a" * 1200]
    texts = ["".join(r.choice(alpha[:-1] if k % 50 else alpha) for _ in range(r.randint(0, 25))) for k in range(4000)]
    for k in range(0, len(texts), 500):
        assert c.encode(texts[k : k + 500], (2).to_bytes(4, "little")) == expected(texts[k : k + 500])


class Counted:
    """The library's tokenizer; counts the texts that it takes apart itself."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_beside_marks_and_digits_are_asked_for_as_words():
    """Words in brackets, before digits, line ends and marks are parts by themselves, so few parts go the library's slow way."""
    r, c = random.Random(7), t.CachedEncoder(PATH)
    c.tokenizer, lib = Counted(c.tokenizer), c.tokenizer
    words = ["".join(r.choice("abcdefgéüñß") for _ in range(9)) for _ in range(3000)]
    text = " ".join(f"({x})" if k % 3 else f"{x}{k}!\n{x};  -{k}" for k, x in enumerate(words))
    assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert c.tokenizer.texts < 20


def test_a_full_cache_keeps_what_several_batches_held():
    c = t.CachedEncoder(PATH, limit=100)
    common = " ".join("common" + "x" * k for k in range(30))
    for k in range(5):
        texts = [common + " " + " ".join(f"rare{'abcde'[k]}" + "y" * i for i in range(40)) + " " + "z" * 1200 * (k == 1)]
        assert c.encode(texts, (2).to_bytes(4, "little")) == expected(texts)
    asked = []
    library = c._library
    c._library = lambda parts: asked.extend(parts.to_pylist()) or library(parts)
    assert c.encode([common, "new"], (2).to_bytes(4, "little")) == expected([common, "new"])
    assert asked == ["new"] and len(c.parts) <= 100


def test_parts_of_all_kinds_of_characters_equal_the_library():
    r, c = random.Random(11), t.CachedEncoder(PATH, limit=2000)
    odd = [0x85, 0xA0, 0xA8, 0xAA, 0xB2, 0xBD, 0xC3, 0xD7, 0xF7, 0xFF, 0x17F, 0x1C0, 0x27F, 0x2B0, 0x300, 0x345, 0x378, 0x3A9, 0x410, 0x47F, 0x482, 0x5D0, 0x660, 0x915, 0x1680, 0x180E, 0x1E9E, 0x1EA5, 0x2000, 0x200A, 0x200B, 0x2019, 0x201C, 0x2026, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x2160, 0x3000, 0x3001, 0x3042, 0x4E00, 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF]
    alphabet = [*map(chr, range(128)), *map(chr, odd)]
    common = [*" \n'  .,\t\r", *"aZ19(_", "'s", "'re", "é", "\u00a0"]
    for _ in range(12):
        texts = ["".join(r.choice(common if r.random() < 0.7 else alphabet) for _ in range(r.randint(0, 30))) for _ in range(2500)]
        assert c.encode(texts, (2).to_bytes(4, "little")) == expected(texts)


def test_query(spark, tmp_path):
    """op1_token_output over a whole table, null and negative ids and a special token's literal included."""
    rows = [(5, "a <|endoftext|> b"), (-7, "minus"), (-1, "one"), (None, "no id"), (0, None), (3, ""), (9, "Word, word. " * 500)]
    rows += [(100 + k, x) for k, x in enumerate(TEXTS)]
    spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(t.op1_token_output(spark, str(tmp_path)).collect(), key=lambda x: x["start"])
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = expected([text])[0]
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [tuple(x) for x in got] == want


def test_shards(spark):
    docs = spark.createDataFrame([(k, x, "clash") for k, x in enumerate([*TEXTS, None])] + [(3, TEXTS[3], "clash")], "doc_id long, text string, shard string")
    path = shared_dir(spark, "test")
    index = t.write_tokens(docs, path, PATH, frame_ids=100)
    got = sorted(t.read_tokens(index, path).select("start", "doc_id", "n_tokens", "ids").collect())
    order = sorted([*enumerate(TEXTS), (3, TEXTS[3]), (len(TEXTS), None)], key=lambda x: x[0])
    want, start = [], 0
    for (k, _), ids in zip(order, expected([x for _, x in order])):
        want.append((start, k, len(ids) // 4, ids))
        start += len(ids) // 4
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == want
    for row in index.collect():
        fs, base = filesystem(path)
        with fs.open_input_file(f"{base}/{row['file']}") as f:
            r = t.ShardReader(f)
            for doc_id in set(r.documents["doc_id"].tolist()) - {3}:
                assert t.read_document(row.asDict(), path, doc_id).tobytes() == expected([dict(order)[doc_id]])[0]


def test_damage_is_found():
    out = io.BytesIO()
    w = t.ShardWriter(out, frame_ids=10)
    for k in range(5):
        w.add(k, np.arange(25, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(out.getvalue())
    assert t.crc32(t.ShardReader(io.BytesIO(bytes(raw))).read(4)) == zlib.crc32(np.arange(25, dtype="<u4").tobytes())
    raw[12] ^= 255
    with pytest.raises(Exception):
        t.ShardReader(io.BytesIO(bytes(raw))).read(0)
    assert len(t.ShardReader(io.BytesIO(bytes(raw))).read(4)) == 100


def test_empty_table(spark):
    path = shared_dir(spark, "test")
    index = t.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert t.read_tokens(index, path).count() == 0
