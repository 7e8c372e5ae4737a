from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "minhash near-dedup", "mixing", "pieces"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{k}")
        docs = spark.read.parquet(path)
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        x = lib.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x).encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert got == sorted(want)


def kneser_ney(texts, order):
    """log p of each n-gram of the highest order, by plain counts in dictionaries."""
    top = Counter(g for t in texts for g in grams(t, order))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    totals, freed = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    kinds, ds = len(counts[1]) + 1, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else 0
        ds[k] = tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)) if y else (0.5, 0.75, 0.9)
        for g, m in c.items():
            totals[k][g[:-1]] += m
            freed[k][g[:-1]] += ds[k][min(m, 3) - 1]
    memo = {}

    def p(g):
        if not g:
            return 1 / kinds
        if g not in memo:
            k, below = len(g), p(g[1:])
            total = totals[k][g[:-1]]
            m = counts[k][g]
            memo[g] = below if not total else (m - ds[k][min(m, 3) - 1] if m else 0) / total + freed[k][g[:-1]] / total * below
        return memo[g]

    return lambda g: np.log(p(g))


def grams(text, order):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").replace("\x02", ""))
    s = "\x02" * (order - 1) + " ".join(w) + " "
    return [s[k : k + order] for k in range(len(s) - order + 1)] if w else []


def crc(k):
    return zlib.crc32(str(k).encode())


def test_run_against_plain_stages(spark):
    """Each stage's rows are those of a plain version of it on the same input."""
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/plain-{k}")
        docs = spark.read.parquet(path)
        steps.append({r["doc_id"]: r for r in docs.collect()})
        if k == 0:
            learn = spark.createDataFrame([(i, r["toxic"]) for i, r in labels.items() if crc(i) % 3 != 1], "doc_id long, toxic int")
            model = toxicity.fit(toxicity.labelled_sample(docs.select("doc_id", "text"), learn), weight_col="weight")
        docs = stage(spark, docs, SF)
    mix = Counter(r[0] for r in docs.select("doc_id").collect())
    assert set(steps[1]) == {i for i, r in steps[0].items() if toxicity.probability(model, toxicity.excess(model, r["text"])[0]) < 0.7}

    good = {i for i, r in labels.items() if r["quality"] == 1}
    lp = kneser_ney([r["text"] for i, r in steps[1].items() if i in good and crc(i) % 2 == 0], 5)
    log_ppl = {i: -np.mean([lp(g) for g in x]) for i, r in steps[1].items() if (x := grams(r["text"], 5))}
    held = [(steps[1][i]["lang"], x) for i, x in log_ppl.items() if i in good and crc(i) % 2 == 1]

    def quantile(values):
        steps_ = sorted(int(np.ceil(x * 10_000 - 1e-9)) for x in values)
        return next(s for n, s in enumerate(steps_, 1) if n >= 0.993 * len(steps_))

    whole, limit = quantile([x for _, x in held]), {}
    for lang in {x for x, _ in held if x is not None}:
        limit[lang] = quantile([x for v, x in held if v == lang])
    near = lambda i: abs(log_ppl[i] - limit.get(steps[1][i]["lang"], whole) / 10_000) < 2e-4
    want = {i for i, x in log_ppl.items() if x <= limit.get(steps[1][i]["lang"], whole) / 10_000}
    assert {i for i in want ^ set(steps[2]) if not near(i)} == set() and len(want) > 50

    sets = {}
    for i, r in steps[2].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    assert set(steps[3]) == {i for i in sets if root(i) == i}

    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in steps[3].items()}
    sizes, taken = Counter(), Counter()
    for i, r in steps[3].items():
        sizes[r["source"]] += words[i]
        taken[r["source"]] += mix[i] * words[i]
    targets = mixing.quotas(dict(sizes), mixing.default_weights(list(sizes)))
    assert all(abs(taken[s] - t) <= max(words.values()) / 2 + 1 for s, t in targets.items()) and max(mix.values()) <= 2 and set(mix) <= set(words)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    long_text = " ".join(f"word{k % 700} thing{k % 31}" for k in range(40_000))
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, " \n\t", "en", "src1", 3), (None, None, None, None, None), (None, "some words without an id", "en", "src0", 5), (9004, long_text, "xx", None, 1), (9005, "twice the same row", "en", "src0", 1), (9005, "twice the same row", "en", "src0", 1)]
    names = ["_kept_id", "weight", "toxic", "perplexity", "size", "rest", "rounds", "_row", "_file", "_block", "key", "id", "sig", "_order", "_at", "trusted_id", "bits", "_metadata_", "lp", "p"]
    table = docs.unionByName(spark.createDataFrame(odd, schema)).select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        if name != "pieces":
            assert out.columns == table.columns, name
        rows = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert rows, name
        if name in ("toxicity", "pieces"):
            assert rows[9005] == 2 and rows[9001] == rows[9002] == rows[9003] == 1 and rows[None] == 2, name
        if name == "quality classifier":
            assert rows[9001] == rows[9002] == rows[9003] == 0 and rows[9005] in (0, 2)
        if name == "minhash near-dedup":
            assert rows[9005] == 2 and rows[None] == 2 and rows[9001] == rows[9002] == rows[9003] == rows[9004] == 1
        if name == "mixing":  # a row for each time that a document is taken, twice at most, for each of the two rows
            assert rows[9001] == rows[9002] == rows[9003] == 0 and rows[9005] <= 4
        assert stage(spark, table.limit(0), SF).count() == 0
