"""Operators 11 to 13 on odd rows against their SQL, and their parts against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat, divergence, filter_audit, queries

AUDITS = ["op11_divergence", "op12_chat", "op13_filter_audit"]


def rows_of(spark, folder, name):
    """The query's rows and its SQL's, over the tables in a folder."""
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, out = queries.queries()[name](spark, str(folder)), c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    return sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr), sorted(out.fetchall(), key=repr)


def odd_documents():
    """Nulls in every column, empty and wordless texts, a very long one, other scripts, one text that a third of all rows have, the
    same id twice, and groups without kept terms."""
    r = random.Random(7)
    words = ["the", "The", "of", "é", "Éa", "日本", "a1b", "x-y", "#tag", "\x85odd", "A B", "zz", "ONE", "don't", "ß", "𝒳y"]
    out = []
    for k in range(900):
        text = " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.choice((3, 30, 300))))
        out.append((k, text, r.choice(("en", "de")), r.choice(("s1", "s2", "s3", "Z", ""))))
    out += [(1000 + k, "one text of many rows", "en", "hot") for k in range(450)]
    out += [(5, "again", "en", "s1"), (5, "again", "en", "s1"), (6, "again", "en", "s2"), (None, "again", "en", "s1"), (None, None, None, None), (2000, None, "en", "s1"), (2001, "", "fr", "only"), (2002, " \t\n", "en", None)]
    out += [(2003, "long " * 200_000 + "end", "en", "s1"), (2004, "rare words here", "es", "s1"), (2005, "rare again", "es", "s2"), (2006, "12 34", "en", "digits"), (2007, "line\x0bbreak\x0cs \x1c kept", "de", "s1")]
    return out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = [(*x, 1, "clash", "clash") for x in odd_documents()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long, term string, _row string").repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 1200, 3)] + [(3, 1, 1), (3, None, 0), (None, 1, 1), (9, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(k, t, r, x) for k in range(20) for t, (r, x) in enumerate([("system", "be <|im_start|> good"), ("user", f"q{k} <|im_end|>"), ("assistant", "a\n\n <\\|im_end|> é日𝒳")][k % 3 :])]
    turns += [(50, 0, None, None), (50, None, "assistant", " lead"), (50, 1, "assistant", "trail "), (50, 1, "assistant", "trail "), (50, 1, "assistant", None), (51, 0, "a<|im_sep|>b\nc", "<"), (51, 1, "assistant", "<|endoftext|>|<"), (52, 0, "assistant", "x" * 300_000), (None, 0, "assistant", "nobody's"), (None, 1, "user", "")]
    turns += [(53, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(400)]
    spark.createDataFrame([(*x, "clash") for x in turns], "conv_id long, turn long, role string, text string, segment string").repartition(4).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", AUDITS)
def test_odd_rows(spark, odd, name):
    got, want = rows_of(spark, odd, name)
    assert got == want and got


@pytest.mark.parametrize("name", AUDITS)
def test_empty_tables(spark, odd, tmp_path, name):
    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = rows_of(spark, tmp_path, name)
    assert got == want and len(got) == (name == "op12_chat")


def test_terms_are_the_pattern():
    def plain(text):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    for _, text, _, _ in odd_documents():
        assert [x.decode() for x in divergence.terms((text or "").encode())] == plain(text or "")
    every = "".join(chr(k) for k in range(0x500) if not 0xD800 <= k < 0xE000)
    assert [x.decode() for x in divergence.terms(every.encode())] == plain(every)


def test_divergence_over_tiles_shards_and_flushes(spark, monkeypatch):
    """More groups than a tile, several shards, and counts that a task gives away early: as by plain sums."""
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    r = random.Random(3)
    docs = [(r.choice(("en", "de")), f"s{r.randint(0, 10)}", " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(0, 25)))) for _ in range(300)]
    got = {(x["lang"], x["source"], x["part"], x["item"]): (x["value"], x["rank"]) for x in divergence.divergence(spark.createDataFrame(docs, "lang string, source string, text string"), min_docs=4, top=3).collect()}
    want = {}
    for lang in ("en", "de"):
        own = [(s, t.split()) for g, s, t in docs if g == lang]
        kept = {t for t in {t for _, w in own for t in w} if sum(t in w for _, w in own) >= 4}
        count = lambda words: {t: words.count(t) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        n = {s: count([t for z, w in own if z == s for t in w]) for s in {s for s, _ in own}}
        p, q = {s: share(c) for s, c in n.items()}, share(count([t for _, w in own for t in w]))
        for s in n:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in n if o != s], "term": [(p[s][t] - q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= 3:
                        want[lang, s, part, item] = (value, rank)
    assert got == want


def test_more_groups_than_are_broadcast(spark, monkeypatch, odd):
    from quillon.llm import shared

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    want = sorted(map(tuple, divergence.divergence(docs).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == want


def test_shares_beyond_64_bits(spark):
    got = spark.range(1).selectExpr("cast(9000000000000000000 as long) n", "cast(9100000000000000000 as long) total", "1000 v").select(divergence.share("n", "total", "v", 10**9, 5)).first()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 5) // (91 * 10**17 + 5000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\>aim_endsrt é\n"), st.text(alphabet="<|\\>aim_endsrtp é\n𝒳"))))
def test_templates_read_back(turns):
    t = chat.Template()
    text, spans = t.render(turns)
    assert list(t.parse(text)) == turns and [chat.unescape(text[a:b]) for _, a, b in spans] == [x for _, x in turns]
    assert all("<|" not in chat.escape(x) and chat.unescape(chat.escape(x)) == x for pair in turns for x in pair)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6)), max_size=4))
def test_mask_by_plain_intersection(widths, parts):
    """Tokens of width 0 stand for parts of a character that share its span."""
    starts, ends, at = [], [], 0
    for w in widths:
        starts.append(at if w else max(0, at - 1)), ends.append(at + w)
        at += w
    spans, at = [], 0
    for gap, size in parts:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    plain = [any(a < hi and b > lo and lo < hi for lo, hi in spans) for a, b in zip(starts, ends, strict=True)]
    assert chat.loss_mask(np.array(starts, int), np.array(ends, int), spans).tolist() == plain


def test_segments_are_the_whole(spark, odd):
    path = P.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{odd}/conversations.parquet")
    whole = {r["conv_id"]: r for r in chat.format_chats(turns, path).collect()}
    parts = chat.format_chats(turns, path, segment_chars=40).cache()
    joined = {}
    for r in parts.orderBy("conv_id", "segment").collect():
        x = joined.setdefault(r["conv_id"], ["", [], []])
        joined[r["conv_id"]] = [x[0] + r["formatted"], x[1] + r["input_ids"], x[2] + r["loss_mask"]]
    assert {k: [r["formatted"], r["input_ids"], r["loss_mask"]] for k, r in whole.items()} == joined and len(parts.collect()) > len(whole)
    assert sorted(map(tuple, chat.read_back(parts, path).collect()), key=repr) == sorted(map(tuple, chat.read_back(chat.format_chats(turns, path), path).collect()), key=repr)
    coder = chat.tokenizer(path, chat.Template())
    for r in whole.values():
        assert coder.decode(r["input_ids"], skip_special_tokens=False) == r["formatted"] and coder.encode(r["formatted"], add_special_tokens=False).ids == r["input_ids"]


def test_tokenizers_whose_tokens_escapes_miss():
    with pytest.raises(ValueError, match="escapes"):
        import tokenizers

        t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.add_special_tokens(["[END]"])
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".json") as f:
            t.save(f.name)
            chat.tokenizer(f.name, chat.Template())


def test_orders_and_shapley(spark):
    """Counts of random sets of failed filters against a plain run of every order."""
    r = random.Random(5)
    rows = [("p" if r.random() < 0.7 else "q", r.randrange(32), r.random() < 0.5, r.random() < 0.3) for _ in range(200)]
    counts = filter_audit.set_counts(spark.createDataFrame(rows, "_part string, failed int, good boolean, toxic boolean"))
    got = {(x["_part"], x["filter_order"], x["step"]): x for x in filter_audit.interactions(counts).collect()}
    assert len(got) == 2 * 600
    shapley = {}
    for part in "pq":
        for order in itertools.permutations("ABCDE"):
            left = [x for x in rows if x[0] == part]
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                x = got[part, "".join(order), step]
                fails = [z for z in rows if z[0] == part and z[1] & bit]
                assert (x["kept"], x["removed"], x["redundant"], x["unique_fails"]) == (len(left), len(out), len(fails) - len(out), sum(z[1] == bit for z in fails))
                assert (x["good_lost"], x["toxic_lost"]) == (sum(z[2] for z in out), sum(z[3] for z in out))
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
    assert all(x["shapley"] == shapley[k[0], k[1][k[2] - 1]] for k, x in got.items())
