from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash

from quillon.llm import language, mixing, perplexity, pieces, quality_rules, toxicity
from pyspark.sql import functions as F

MODEL = P.path("piece_bpe_32k.model")


def test_pieces_equal_the_library():
    lib, c, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(MODEL, limit=50), random.Random(1)
    texts = ["", " ", "  a", "a ", "a  b", "\n", "▁", "a▁b", "日本語 テスト", "😀x", "<s> </s> <0x41>", "\x00a", "a" * 300, "11 22 1234567", "\r\n\r\n", "�", "x y", " ▁ ▁"]
    alpha = "abcdefghij ABC  éñüß.,;:!?0123456789\n\t▁日本😀-_'\"()<>"
    texts += ["".join(r.choice(alpha) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    common = "the of and in to a is er en st ti on at re nt th".split()
    texts += ["".join(r.choice([*common, " "]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for x in texts:
        ids = lib.encode(x, add_bos=True, add_eos=True)
        assert np.frombuffer(c.encode(x), "<u4").tolist() == ids
        assert c.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)
    assert c.monotone


def test_compatibility_equals_merging():
    c, r = pieces.PieceCodec(MODEL), random.Random(2)
    c._prepare()
    ids = [k for k in c.edges if len(c.names[k]) < 6]
    for _ in range(4000):
        a, b = r.choice(ids), r.choice(ids)
        assert c.compatible(a, b) == ([x[0] for x in c._merge(c.names[a] + c.names[b])] == [a, b])


def test_decoding_broken_bytes():
    lib, c, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(MODEL), random.Random(3)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 260), r.randint(0, 31999)]) for _ in range(r.randint(0, 8))]
        assert c.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)


def test_piece_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (2, None, 6)], "doc_id long, text string, ids int")
    got = sorted(pieces.decode_pieces(pieces.encode_pieces(d, MODEL), MODEL).select("doc_id", "ids", "decoded").collect())
    assert [(x[0], len(x[1]) // 4, x[2]) for x in got] == [(1, 4, "a b"), (2, 2, ""), (2, 2, "")]
    assert pieces.digests(d, MODEL).where("doc_id = 2").first()["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    c, covered = Counter(win), set()
    for k, x in enumerate(win):
        if c[x] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark):
    r = random.Random(4)
    words = [f"word{k}" for k in range(300)]
    texts = [None, "", " \n\x0b", "a\x1cb c d", "# $ x\nx\n x\nx", "a b c d e f g h " * 9, "q " * 15, "# * $ junk " * 40]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) + ("\nsame line\n \nsame line" if k % 3 else "") for k in range(120)]
    texts += [" ".join(words[:30] * 3 + ["x"] * k) for k in range(30)]
    d = spark.createDataFrame([(k, x, True, k, k) for k, x in enumerate(texts)] + [(9, texts[9], True, 0, 0)], "doc_id long, text string, kept boolean, trusted_id int, _row int")
    trusted = spark.createDataFrame([(k,) for k in range(8, 100, 2)] + [(None,)], "doc_id long")
    buckets = 512
    got = quality_rules.judge(d, trusted, buckets).collect()
    assert Counter(x["doc_id"] for x in got)[9] == 2 and len(got) == len(texts) + 1
    by = {x["doc_id"]: x for x in got}

    def grams(t):
        h = [np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42))) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

        def pair(a, b):  # Spark hashes the second value with the first one's hash as seed
            one = xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), 42)
            return np.int64(np.uint64(xxhash.xxh64_intdigest(int(b).to_bytes(8, "little", signed=True), one)))

        return [int(x) % buckets for x in h] + [int(pair(a, b)) % buckets for a, b in zip(h, h[1:])]

    import zlib

    half = {k: zlib.crc32(str(k).encode()) % 2 for k in range(8, 100, 2)}
    raw, target = Counter(), Counter()
    for k, x in [*enumerate(texts), (9, texts[9])]:
        raw.update(grams(x))
        if half.get(k) == 0:
            target.update(grams(x))
    n, m = sum(raw.values()) + buckets, sum(target.values()) + buckets
    for k, x in enumerate(texts):
        g = grams(x)
        score = np.mean([np.log((target[b] + 1) / m / ((raw[b] + 1) / n)) for b in g]) if g else 0.0
        assert tuple(by[k][c] for c in quality_rules.MEASURES) == rules(x), k
        assert by[k]["score"] == pytest.approx(score, abs=1e-9)
        q = rules(x)
        assert by[k]["base_failed"] == (q[0] < 20 or 100 * q[4] > 30 * q[0])
    low = min(by[k]["score"] for k in half if half[k] == 1)
    assert all(x["kept"] == (not x["base_failed"] and x["score"] >= low) for x in got)


def test_quality_rules_without_trust(spark):
    d = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.judge(d.limit(0), none).count() == 0
    assert {x["doc_id"]: x["kept"] for x in quality_rules.judge(d, none).collect()} == {1: False, 2: False}


def test_segments_equal_brute_force():
    r = np.random.default_rng(1)
    for n in range(0, 40):
        for _ in range(30):
            s = r.normal(-0.3, 1, n)
            got = toxicity.maximal_segments(s)

            def split(lo, hi):  # the definition: the largest segment, then what lies left and right of it
                best = max(((s[a:b].sum(), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
                if best[0] <= 1e-12:
                    return []
                a, b = -best[1], -best[2]
                return split(lo, a) + [round(float(best[0]), 6)] + split(b, hi)

            assert [round(float(x[2]), 6) for x in got] == split(0, n)


def test_segments_in_linear_time():
    """Running sums that fall all along, the usual case, and that rise: ten times the tokens, about ten times the time."""
    import time

    def seconds(n, high):
        s = np.tile([1.0, high], n // 2)
        began = time.perf_counter()
        found = toxicity.maximal_segments(s)
        assert len(found) == (n // 2 if high < 0 else 1)
        return time.perf_counter() - began

    for high in (-2.0, -1.0, -0.5, 0.5):
        small = min(seconds(40_000, high) for _ in range(3)) if high < -1 else None
        if small is not None:
            assert min(seconds(400_000, high) for _ in range(3)) < 30 * small
    for s in (np.tile([1.0, -0.5], 200_000), np.tile([1.0, -0.5, -2.0], 100_000)):
        assert toxicity.maximal_segments(s)


def test_odds_extreme_law_and_score_equal_brute_force(spark):
    """fit_odds, the law and the score against plain versions from their definitions."""
    import math

    r = random.Random(46)
    clean, bad = [f"calm{k}" for k in range(60)], ["vilest", "vile", "nasty"]
    rows = []
    for k in range(300):
        w = [r.choice(clean) for _ in range(r.randint(5, 40))] + ([r.choice(bad) + "!" for _ in range(3)] if k % 4 == 0 else [])
        r.shuffle(w)
        rows.append((" ".join(w).title() if k % 2 else "\u00a0".join(w[:3]) + " " + " ".join(w[3:]), int(k % 4 == 0), 2.0 if k % 4 == 0 else 1.0))
    d = spark.createDataFrame(rows, "text string, toxic long, weight double")
    model = toxicity.fit_odds(toxicity.count_contexts(d))
    plain = lambda t: [w.lower().strip(toxicity.EDGE) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = {}
    for t, x, weight in rows:
        w = plain(t)
        for i, v in enumerate(w):
            if v:
                c = (v, w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None)
                seen[c] = max(seen.get(c, (0, 0)), (x, weight))
    table = {}
    for (v, _, _), (x, weight) in seen.items():
        for key in [v, *[v[:n] + "*" for n in toxicity.BEGINNINGS if len(v) > n]]:
            a = table.setdefault(key, [0.0, 0.0, 0.0])
            a[0] += x * weight
            a[1] += weight
            a[2] += weight * weight
    share = sum(x * w for x, w in seen.values()) / sum(w for _, w in seen.values())
    logit = lambda q: math.log(q / (1 - q))
    assert len(model.codes) == len(table)
    for key, odds in zip(table, model.find(list(table))[0].tolist(), strict=True):
        at, name = share, key.removesuffix("*")
        for part in [*[name[:n] + "*" for n in sorted(toxicity.BEGINNINGS) if len(name) > n], key]:
            b, n, q = table[part]
            at = (b / n * (n * n / q) + 40 * at) / (n * n / q + 40)
        assert odds == pytest.approx(logit(at) - logit(share), abs=1e-9)
    assert model.find([*table, "unseen"])[1].tolist() == [True] * len(table) + [False]
    known = dict(zip(table, model.find(list(table))[0].tolist(), strict=True))
    model.rate, model.scale = 1.2, 0.01
    for t, _, _ in rows[:40]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = []
        for k, w in enumerate(words):
            v = plain(w)[0]
            x = known.get(v, next((known[v[:n] + "*"] for n in toxicity.BEGINNINGS if len(v) > n and v[:n] + "*" in known), 0.0))
            if x > model.drift:
                x /= 1 + sum(math.exp((j - k) / toxicity.MEMORY) for j in range(k) if words[j] == w)
            s.append(x - model.drift)
        segments, parts = [], [(0, len(s))]
        while parts:
            lo, hi = parts.pop()
            best = max(((sum(s[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] > 1e-12:
                segments.append(best[0])
                parts += [(lo, -best[1]), (-best[2], hi)]
        each = [1.2 * x - math.log(0.01 * len(words)) for x in segments]
        good = [x for x in each if math.exp(-x) <= 0.05]
        want = min(12.0, sum(good)) if good else max(-10.0, max(each, default=-10.0))
        assert toxicity.excess(model, t)[0] == pytest.approx(want, abs=1e-9)
    # The extreme-value law: samples of it give its parameters back.
    g = np.random.default_rng(3)
    n = g.integers(50, 2000, 4000)
    rate, scale = toxicity._extreme_law((np.log(0.02 * n) - np.log(-np.log(g.random(4000)))) / 1.5, n.astype(float))
    assert abs(rate - 1.5) < 0.08 and abs(scale - 0.02) < 0.006


def test_toxicity(spark):
    r = random.Random(6)
    clean, bad = [f"calm{k}" for k in range(400)], [f"vile{k}" for k in range(6)]

    def doc(toxic):
        w = [r.choice(clean) for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(3, 8) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad).upper() + ",")
        return " ".join(w)

    rows = [(k, doc(k % 4 == 0), int(k % 4 == 0)) for k in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.where("doc_id < 900"))
    tests = d.where("doc_id >= 900").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "vile0 " * 100_000)], "doc_id long, text string"))
    got = {x["doc_id"]: x for x in toxicity.score(tests, model).collect()}
    assert len(got) == 303 and all(0 <= x["score"] <= 1 for x in got.values())
    assert np.mean([(got[k]["score"] >= 0.7) == (k % 4 == 0) for k in range(900, 1200)]) > 0.97
    assert any("VILE" in p["text"] for p in got[904]["passages"]) and got[-1]["score"] == got[-2]["score"] < 0.5
    kept = {x["doc_id"] for x in toxicity.keep_harmless(tests, model).collect()}
    assert kept == {k for k, x in got.items() if x["score"] < 0.7}
    flat = toxicity.fit(d.where("toxic = 0"))
    assert all(x["score"] < 0.7 for x in toxicity.score(tests, flat).collect())


def test_scores_of_words_by_longest_known_beginning(spark):
    """Codes are Spark's, a memo that overflows and words too long for it change nothing."""
    model = toxicity.Model.of({"vile": 2.0, "vil*": 1.0, "vilesome*": 9.0, "villa*": -1.0, "é*": 5.0}, 0.5)
    words = ["Vile,", "vilest", "VILLAGE", "villas" * 100, "calm", "é", "", "...", "vile"]
    want = [1.5, 0.5, -1.5, -1.5, -0.5, -0.5, -0.5, -0.5, 1.5]
    assert model.scores(words).tolist() == want and model.scores(words[::-1]).tolist() == want[::-1]
    model.memo.update((str(k), 0.0) for k in range(150_001))
    assert model.scores([*words, "7"]).tolist() == [*want, 0.0] and len(model.memo) < 100
    tokens = ["a", "é𝒳", "", "long" * 50]
    assert toxicity.token_codes(tokens).tolist() == [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(F.xxhash64("t")).collect()]


def test_a_dense_passage_after_earlier_mentions():
    bad = [f"vile{k}" for k in range(6)]
    model = toxicity.Model.of({w: 3.0 for w in bad} | {"be": 0.6, "calm": 0.4}, 0.5, 1.0, 0.05)
    early = [x for k in range(18) for x in (*["calm"] * 100, bad[k % 6])]
    text = [*early, *["calm"] * 100, *bad, *["calm"] * 300, *bad, *["calm"] * 100]
    found = toxicity.excess(model, " ".join(text))[1]
    assert [(lo, hi) for lo, hi, _ in found] == [(1918, 1924), (2224, 2230)]
    assert toxicity.excess(model, "be " * 5000)[1] == []  # close repetition of a slightly indicative word


def test_toxicity_shares_do_not_hang_on_the_sample(spark):
    r = random.Random(16)
    clean, bad = [f"calm{k}" for k in range(300)], [f"vile{k}" for k in range(6)]
    rows = []
    for k in range(1600):
        w = [r.choice(clean) for _ in range(r.randint(20, 60))]
        for _ in range(4 if k % 10 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), int(k % 10 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    full, own = toxicity.fit(d), toxicity.fit(d, max_docs=160)
    sample = toxicity.labelled_sample(d.select("doc_id", "text"), d.select("doc_id", "toxic"), max_docs=160)
    assert abs(sample.agg(F.sum("weight")).first()[0] - 1600) < 400 and sample.count() < 450
    two = toxicity.fit(sample, max_docs=160, weight_col="weight")
    for model in (own, two):
        assert (abs(model.find(bad)[0] - full.find(bad)[0]) < 0.7).all() and model.find(bad)[1].all()
    x, y = np.array([-3, -2, -1, 0, 1, 2, -1, 0, 2, 3.0]), np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 1.0])
    more = np.where(y == 0, 8, 1)
    slope, bias = toxicity._logistic(x, y, more.astype(float))
    far = toxicity._logistic(np.repeat(x, more), np.repeat(y, more))
    assert abs(bias - far[1]) < 0.3 and bias < toxicity._logistic(x, y)[1] - 1.5


def test_quotas_and_flow():
    q = mixing.quotas({"a": 100, "b": 50, None: 10}, mixing.default_weights(["b", None, "a"]))
    assert mixing.default_weights(["b", None, "a"]) == {"a": 3, "b": 1, None: 2} and q[None] == 20 and sum(q.values()) == pytest.approx(240) and all(q[k] <= 2 * n for k, n in {"a": 100, "b": 50}.items())
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150.0, "b": 120.0})
    assert sum(v["a"] for v in flow.values() if "a" in v) == pytest.approx(150) and sum(v["b"] for v in flow.values() if "b" in v) == pytest.approx(120)
    # One round costs nothing, so as much as possible comes from first rounds: 210 of 270.
    assert sum(min(sum(v.values()), {("a",): 100, ("a", "b"): 100, ("b",): 10}[p]) for p, v in flow.items()) == pytest.approx(210)


def test_mixing(spark):
    r = random.Random(7)
    texts = [" ".join(["w"] * r.randint(0, 300)) for _ in range(300)]
    rows = [(k, None if k == 5 else x, (["a", "b", None] + ["a"] * 3)[k % 6], k) for k, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    plan = mixing.plan_mix(d, F.array("source"))
    targets = plan._mix[1]
    got = plan.collect()
    again = {x["doc_id"]: x["taken"] for x in mixing.plan_mix(d, F.array("source")).collect()}
    assert {x["doc_id"]: x["taken"] for x in got} == again and all(x["taken"] <= 2 * x["size"] for x in got)
    words = Counter()
    for x in got:
        words[x["_pattern"][0]] += x["taken"]
    assert all(abs(words[s] - t) <= 1 for s, t in targets.items())
    mix = mixing.mixed_documents(d, F.array("source"))
    assert mix.columns == d.columns
    out = Counter()
    for x in mix.collect():
        assert x["text"] == rows[x["doc_id"]][1]
        out[x["source"]] += len(x["text"].split())
    # Documents go in whole: each source is off its target by half a document at most.
    assert all(abs(out[s] - t) <= 150 for s, t in targets.items())
    assert mixing.plan_mix(d.limit(0), F.array("source")).count() == 0 == mixing.mixed_documents(d.limit(0), F.array("source")).count()


def cheapest_flow(patterns, targets, most):
    """Plain version: the largest amount, then the least cost, by brute force over whole words."""
    names, best = sorted(targets), (-1, 0)
    ways = []
    for p, size in patterns.items():
        ways.append([dict(zip(p, w)) for w in itertools.product(range(most * size + 1), repeat=len(p)) if sum(w) <= most * size])
    cost = lambda size, w: sum(max(0, min(w - r * size, size)) * r for r in range(most))
    for way in itertools.product(*ways):
        into = {x: sum(w.get(x, 0) for w in way) for x in names}
        if all(into[x] <= targets[x] for x in names):
            best = max(best, (sum(into.values()), -sum(cost(size, sum(w.values())) for size, w in zip(patterns.values(), way))))
    return best


def test_flow_equals_brute_force():
    r = random.Random(27)
    for _ in range(40):
        names = ["a", "b", "c"][: r.randint(1, 3)]
        kinds = [p for n in (1, 2) for p in itertools.combinations(names, n)]
        patterns = {p: r.randint(0, 3) for p in r.sample(kinds, min(len(kinds), r.randint(1, 3)))}
        targets = {x: float(r.randint(0, 6)) for x in {x for p in patterns for x in p}}
        flow = mixing.route(patterns, targets, 2)
        into = Counter()
        for w in flow.values():
            into.update(w)
        amount = sum(into.values())
        spent = sum(max(0, sum(w.values()) - patterns[p]) for p, w in flow.items())
        assert all(into[x] <= targets[x] + 1e-6 for x in targets) and all(sum(w.values()) <= 2 * patterns[p] + 1e-6 for p, w in flow.items())
        assert (amount, -spent) == pytest.approx(cheapest_flow(patterns, targets, 2), abs=1e-6)


def test_mixing_overlapping_sources(spark):
    """What the plan takes of each pattern is what the flow of least cost sends out of it."""
    r = random.Random(37)
    kinds = [["x"], ["x", "y"], ["y", "z"], ["z"], []]
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), kinds[k % 7 % 5]) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, from array<string>")
    plan = mixing.plan_mix(d, F.col("from"))
    got, totals = Counter(), Counter()
    for x in plan.collect():
        got[tuple(x["_pattern"])] += x["taken"]
        totals[tuple(x["_pattern"])] += x["size"]
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and 0 <= x["taken"] <= 2 * x["size"]
    sizes = Counter()
    for p, n in totals.items():
        sizes.update({x: n for x in p})
    targets = mixing.quotas(sizes, mixing.default_weights(list(sizes)))
    flow = mixing.route(totals, targets)
    assert all(abs(got[p] - sum(flow[p].values())) <= 1 for p in totals)


def test_mixing_repeated_rows_and_clashing_names(spark):
    one = "a b c d e f g h i j"
    rows = [(7, one, "s", 1, 2, 3, 4, 5, {"k": 1}) for _ in range(40)] + [(None, None, None, 1, 2, 3, 4, 5, None), (8, "", "s", 1, 2, 3, 4, 5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, rest int, size int, rounds int, _o int, _row int, _k map<string,int>")
    share = 555 / 400
    plan = [x["taken"] for x in mixing.plan_mix(d, F.array("source"), share=share).collect()]
    assert sum(plan) == 555 and sorted(plan)[:3] == [0, 0, 10] and max(plan) == 20
    mix = mixing.mixed_documents(d, F.array("source"), share=share)
    assert mix.columns == d.columns and mix.count() == 56 and {x["text"] for x in mix.collect()} == {one}  # 15.5 rows go in twice: 16
    none = d.where("text is null")
    assert mixing.mixed_documents(none, F.array("source")).count() == 0 and mixing.plan_mix(none, F.array("source")).first()["taken"] == 0


def grams_of(text, order):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.replace("\x02", ""))
    s = "\x02" * (order - 1) + " ".join(w) + " "
    return [s[k : k + order] for k in range(len(s) - order + 1)] if w else []


def kneser_ney(texts, order):
    top = Counter(g for t in texts for g in grams_of(t, order))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    kinds, ds = len(counts[1]) + 1, {}
    for k, c in counts.items():
        n = Counter(c.values())
        if not n[1] or not n[2] or not n[3]:
            ds[k] = (0.5, 0.75, 0.9)
            continue
        y = n[1] / (n[1] + 2 * n[2])
        ds[k] = tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))

    def p(g, k):
        if k == 0:
            return 1 / kinds
        c, d = counts[k], ds[k]
        same = [n for h, n in c.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:], k - 1)
        freed = sum(d[min(n, 3) - 1] for n in same)
        return max(c[g] - d[min(c[g], 3) - 1], 0) / sum(same) * (g in c) + freed / sum(same) * p(g[1:], k - 1)

    return lambda g: p(g, order)


def test_perplexity(spark):
    r = random.Random(8)
    syl = ["ka", "to", "mi", "re", "su"]
    good = [" ".join("".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(30)) for _ in range(200)]
    junk = [" ".join("".join(r.choice("qxz#$") for _ in range(5)) for _ in range(30)) for _ in range(20)]
    rows = [(k, t, "en" if k % 2 else None, 1) for k, t in enumerate(good + junk)] + [(900, None, "en", 1), (901, " ", "en", 1), (902, "\x02kato", "xx", 1), (3, good[3], "en", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int")
    trusted = spark.createDataFrame([(k,) for k in range(150)], "doc_id long")
    got = perplexity.classify(d, trusted, order=3).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    import zlib

    p = kneser_ney([good[k] for k in range(150) if zlib.crc32(str(k).encode()) % 2 == 0] + ([good[3]] if zlib.crc32(b"3") % 2 == 0 else []), 3)
    for k in (0, 7, 151, 199, 205):
        grams = grams_of((good + junk)[k], 3)
        assert by[k]["perplexity"] == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams])), rel=1e-9)
    assert sum(by[k]["kept"] for k in range(200)) >= 192 and not any(by[k]["kept"] for k in range(200, 220))
    assert by[900]["perplexity"] is None and not by[900]["kept"] and not by[901]["kept"]
    # A language without trusted documents, as null, has the quantile of all.
    assert by[902]["threshold"] == by[0]["threshold"] and by[902]["kept"] == (by[902]["perplexity"] <= by[902]["threshold"])
    assert {x["doc_id"] for x in perplexity.keep_good(d, trusted, order=3).collect()} == {k for k, x in by.items() if x["kept"]}
    assert perplexity.classify(d.limit(0), trusted, order=3).count() == 0


def test_perplexity_across_words(spark):
    r = random.Random(18)
    ring = ["ka", "tomi", "resu", "a", "mire", "so"]
    after = {w: [ring[(k + 1) % 6], ring[(k + 2) % 6]] for k, w in enumerate(ring)}

    def text(n):
        out = [r.choice(list(after))]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return out

    good = [text(60) for _ in range(200)]
    mixed = [r.sample(x, len(x)) for x in good[150:160]]
    rows = [" ".join(x) for x in good + mixed] + ["ka " * 60, "so " * 60, "a", "a a\tb"]
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(rows)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(150)], "doc_id long")
    got = {x["doc_id"]: x for x in perplexity.classify(d, trusted, order=4).collect()}
    import zlib

    p = kneser_ney([rows[k] for k in range(150) if zlib.crc32(str(k).encode()) % 2 == 0], 4)
    for k in (0, 155, 203, 211, 212, 213):
        assert got[k]["perplexity"] == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams_of(rows[k], 4)])), rel=1e-9)
    assert all(got[k + 200]["perplexity"] > 1.2 * got[k + 150]["perplexity"] for k in range(10))
    assert not any(got[k]["kept"] for k in range(200, 212)) and sum(got[k]["kept"] for k in range(200)) > 190


def test_perplexity_of_blocks_and_pieces(spark, tmp_path, monkeypatch):
    """Rows don't depend on files, blocks, splits or pieces; long texts and foreign white space count as they are."""
    r = random.Random(38)
    rows = [(k, " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 60))), "en") for k in range(300)]
    rows += [(400, "ab\u00a0cd\u3000e f\x1cg", "en"), (401, "abc de " * 30_000, None), (402, "", "en"), (403, None, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("step", F.lit("x"))
    trusted = spark.createDataFrame([(k,) for k in range(200)], "doc_id long")
    want = {x["doc_id"]: x for x in perplexity.classify(d, trusted, order=4).collect()}
    d.repartition(7).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(perplexity, "PIECE", 64)
    monkeypatch.setattr(perplexity.perplexities, "__defaults__", (5, "doc_id", "text", 16))
    got = {x["doc_id"]: x for x in perplexity.classify(files, trusted, order=4).collect()}
    assert got == want and len(got) == len(rows)
    assert [perplexity.stream(x, 2) for x in ("a\u00a0b c", "\x1c", " \t")] == ["\x02a\u00a0b c ", "\x02\x1c ", ""]
    texts, total = [x[1] for x in rows], {}
    for text, owner, start in perplexity.pieces_of(texts, 4):
        ends = [*start[1:], len(text)]
        for k, lo, hi in zip(owner, start, ends, strict=True):
            total.setdefault(k, []).extend(text[i : i + 4] for i in range(lo, hi - 3))
    assert all(total.get(k, []) == grams_of(x or "", 4) for k, x in enumerate(texts))


def test_threshold_of_a_rare_language(spark):
    import zlib

    r = random.Random(28)
    syl = {"en": ["ka", "to", "mi", "re", "su"], "xx": ["qua", "zön", "vyl", "ghw", "pfö", "ryx", "ßei", "ñud"]}
    doc = lambda x: " ".join("".join(r.choice(syl[x]) for _ in range(r.randint(1, 3))) for _ in range(30))
    rows = [(k, doc(x := "xx" if k % 40 == 0 else "en"), x) for k in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(400)], "doc_id long")
    got = {x["doc_id"]: x for x in perplexity.classify(d, trusted, order=3).collect()}
    held = {x: [got[k]["perplexity"] for k in range(400) if rows[k][2] == x and zlib.crc32(str(k).encode()) % 2] for x in syl}
    assert 0 < len(held["xx"]) < 10 and min(held["xx"]) > 1.1 * np.median(held["en"])
    rare = [got[k] for k in range(0, 800, 40)]
    # A few documents' quantile is their largest perplexity (rounded up to a step); each language has its own, whatever the other's.
    most = np.exp(np.ceil(np.log(max(held["xx"])) * perplexity.STEPS - 1e-9) / perplexity.STEPS)
    assert all(x["threshold"] == pytest.approx(most, rel=1e-9) for x in rare)
    assert all(got[k]["kept"] for k in range(0, 400, 40)) and sum(x["kept"] for x in rare) >= 15
    assert got[1]["threshold"] <= max(held["en"]) * 1.0001 < rare[0]["threshold"]


def test_language(spark):
    r = random.Random(9)
    syl = {"aa": ["ka", "to", "mi", "zu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["eau", "oir", "que", "é"]}
    doc = lambda x, n: " ".join("".join(r.choice(syl[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(k, doc(x := list(syl)[k % 3], r.randint(2, 60)), x) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d.where("doc_id < 400"), landmarks=30)
    odd = spark.createDataFrame([(-1, None, None), (-2, " 12 # ", None), (-3, "sch " * 50_000, None)], d.schema)
    got = {x["doc_id"]: x for x in language.identify(d.where("doc_id >= 400").unionByName(odd), model).collect()}
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in range(400, 600)]) > 0.98
    assert [got[k]["lang_pred"] for k in (-1, -2, -3)] == ["und", "und", "bb"] and got[-1]["score"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    assert language.fit(d.limit(0)) is None
    assert {x["lang_pred"] for x in language.identify(d.limit(3), None).collect()} == {"und"}


def test_perplexity_writes_grams_without_codes(spark, monkeypatch):
    """Codes, which don't compress, are no column of the tables on disk."""
    from quillon.llm import perplexity

    seen, was = {}, perplexity.materialize
    monkeypatch.setattr(perplexity, "materialize", lambda df, label: (seen.setdefault(label, df.columns), was(df, label))[1])
    docs = spark.createDataFrame([(k, "the cat sat on the mät \U0001f600" if k % 2 else "a dog") for k in range(6)], "doc_id long, text string")
    got = [r["perplexity"] for r in perplexity.perplexities(docs, docs.where("doc_id < 4").select("text")).collect()]
    assert all(x and x > 1 for x in got) and seen["kn-asked"] == ["file", "block", "gram"]
