"""Operator 8. Toxicity by maximum-scoring segments.

Training counts, for each word and each word beginning, the distinct contexts (word before, word after) in toxic and other
labelled texts, so copies of a text count once. Log-odds come from a chain of Dirichlet priors: a word's prior is its
longest beginning's share, that one's prior the next shorter one's, the shortest one's the share of all tokens. A linear
scan finds all maximal segments of positive score in a document. The largest segment of harmless texts follows an
extreme-value law; a segment is significant if its expected number in a harmless text of that length is small. The
document's score is a logistic function of the significant segments' summed excess, fitted on labelled texts apart from
those that the log-odds are from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import CACHED_LENGTH, ascii_words, bounded_batches, claim, materialize, release

#: Marks stripped from both ends of a word, besides its case.
EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_=+/\\~`"
BEGINNINGS = (8, 7, 6, 5, 4, 3)
#: Taken from every token's log-odds, so that a harmless text's mean is below 0 and segments end.
DRIFT = 0.5
#: Bounds of a document's excess.
LOWEST, HIGHEST = -10.0, 12.0
#: Words after which a token's occurrence weighs 1/e in the discount of its next one.
MEMORY = 50.0


def token_codes(tokens: list[str]) -> np.ndarray:
    """64-bit codes of tokens, those of Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in tokens), np.uint64, len(tokens)).view(np.int64)


@dataclass
class Model:
    """The log-odds of all tokens and beginnings of the labelled rows, by sorted codes (16 bytes each; the rows are a bounded
    sample), and the calibration. It travels with the tasks."""

    codes: np.ndarray
    odds: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0  # of the extreme-value law
    scale: float = 1.0
    slope: float = 1.0
    bias: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, odds: dict[str, float], *more: float) -> Model:
        codes = token_codes(list(odds))
        order = np.argsort(codes)
        return cls(codes[order], np.array(list(odds.values()), float)[order], *more)

    def find(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of tokens, and whether each is known."""
        if not len(self.codes) or not tokens:
            return np.zeros(len(tokens)), np.zeros(len(tokens), bool)
        codes = token_codes(tokens)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.odds[at], self.codes[at] == codes

    def learn(self, words: list[str]) -> dict[str, float]:
        """Scores of raw words: a word's own log-odds, or its longest known beginning's, or 0, less the drift."""
        asked, starts = [], []
        for word in words:
            plain = word.lower().strip(EDGE)
            starts.append(len(asked))
            asked.append(plain)
            asked += [plain[:n] + "*" for n in BEGINNINGS if len(plain) > n]
        odds, known = self.find(asked)
        first = np.minimum.reduceat(np.where(known, np.arange(len(asked)), len(asked)), starts)
        return dict(zip(words, (np.append(odds, 0.0)[first] - self.drift).tolist(), strict=True))

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of raw words, each distinct one looked up once while the memo holds it."""
        new = [w for w in set(words) if w not in self.memo]
        found = self.learn(new) if new else {}
        if len(self.memo) > 150_000:
            found |= {w: self.memo[w] for w in set(words) if w in self.memo}
            self.memo.clear()
        self.memo.update((w, x) for w, x in found.items() if len(w) <= CACHED_LENGTH)
        return np.fromiter((self.memo[w] if w in self.memo else found[w] for w in words), float, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one after last, sum > 0) of a sequence, disjoint, in order, in linear time.

    Neighbouring scores of one sign are added up first. A stack holds candidate segments by the running sums before and
    after them, each with the nearest earlier one whose running sum before it is smaller; a new one swallows those from
    there on while that makes it larger, and skips by these links what can't matter to it.
    """
    n = len(scores)
    if not n:
        return []
    positive = scores > 0
    if not positive.any():
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(positive)) + 1])
    sums = np.add.reduceat(scores, starts)
    after = np.cumsum(sums)
    runs = np.flatnonzero(positive[starts])
    lows, highs = (after[runs] - sums[runs]).tolist(), after[runs].tolist()
    ends = np.append(starts, n)
    firsts, lasts = ends[runs].tolist(), ends[runs + 1].tolist()
    # Columns of the stack: first, one after last, running sum before, and after, link.
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for lo, hi, before, top in zip(firsts, lasts, lows, highs, strict=True):
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = link[j]
            if j < 0 or high[j] >= top:
                break
            lo, before = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            j, below = link[j], j
            del link[below:]
        first.append(lo), last.append(hi), low.append(before), high.append(top), link.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


def token_scores(model: Model, words: list[str]) -> np.ndarray:
    """Scores of a text's words. Each occurrence of a token counts; close repetition adds little: a positive score's log-odds
    are divided by 1 + the sum of exp(-distance / MEMORY) over the token's earlier occurrences, and come back as these fall
    behind. So what is found in a passage doesn't hang on what the text says far before it."""
    scores = model.scores(words)
    seen: dict[str, tuple[int, float]] = {}
    for k in np.flatnonzero(scores > 0).tolist():
        at, near = seen.get(words[k], (k, 0.0))
        near *= math.exp((at - k) / MEMORY)
        seen[words[k]] = (k, near + 1.0)
        scores[k] = (scores[k] + model.drift) / (1.0 + near) - model.drift
    return scores


def excess(model: Model, text: str | None, limit: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed excess of the significant segments (or that of the largest, below 0 as it may be), and these segments with
    their expected numbers in a harmless text as long. The excess is held to LOWEST and HIGHEST, far out on either side of
    the logistic; a text without words or segments has the lowest."""
    words = ascii_words(text)
    found = maximal_segments(token_scores(model, words)) if words else []
    if not found:
        return LOWEST, []
    base = math.log(model.scale * len(words))
    each = [(lo, hi, model.rate * s - base) for lo, hi, s in found]
    good = [(lo, hi, x) for lo, hi, x in each if x >= -math.log(limit)]
    if good:
        return min(HIGHEST, sum(x for _, _, x in good)), [(lo, hi, math.exp(-x)) for lo, hi, x in good]
    return max(LOWEST, max(x for _, _, x in each)), []


def probability(model: Model, x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.bias))))


def _extreme_law(largest: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """rate and scale of P(M > s) = 1 - exp(-scale * n * exp(-rate * s)), by moments of M - log(n) / rate, iterated."""
    if len(largest) < 20 or largest.std() < 1e-9:
        return 1.0, 0.05
    rate = 1.0
    for _ in range(20):
        y = largest - np.log(lengths) / rate
        rate = min(3.0, max(0.3, math.pi / (math.sqrt(6) * max(1e-6, y.std()))))
    y = largest - np.log(lengths) / rate
    return rate, math.exp(rate * (y.mean() - 0.5772156649 / rate))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """slope and bias of P(1 | x), a little shrunk; Newton steps. Rows by their weights, scaled to a mean of 1."""
    if not len(x) or y.min() == y.max():
        return 1.0, -3.0
    c = np.ones(len(x)) if weight is None else weight / weight.mean()
    share = float((c * y).mean())
    w = np.array([0.5, math.log(share / (1 - share))])
    m = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = m @ w
        return float((c * (np.logaddexp(0, z) - y * z)).sum() + 0.25 * w[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (c * (p - y)) + np.array([0.5 * w[0], 0])
        h = (m * (c * (p * (1 - p) + 1e-6))[:, None]).T @ m + np.diag([0.5, 0])
        step, now = np.linalg.solve(h, g), loss(w)
        while abs(step).max() > 1e-9 and loss(w - step) > now:
            step /= 2
        w -= step
        if abs(step).max() < 1e-8:
            break
    return max(0.05, float(w[0])), float(w[1])


def count_contexts(train: DataFrame) -> DataFrame:
    """token, bad, all, square, n: distinct contexts of each word, and of each word beginning (marked by a star), in toxic
    texts and in all, by weight; their weights' squares, and their number. train: text, toxic, weight (one for each label)."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "\\s+")
    plain = F.transform(words, lambda w: F.btrim(w, F.lit(EDGE)))
    rows = train.select("toxic", "weight", plain.alias("w"))
    around = F.transform("w", lambda w, i: F.struct(w.alias("token"), F.xxhash64(F.coalesce(F.when(i > 0, F.get(F.col("w"), i - 1)), F.lit("\n")), F.coalesce(F.get(F.col("w"), i + 1), F.lit("\n"))).alias("context")))
    seen = rows.select("toxic", "weight", F.inline(around)).where("token <> ''").groupBy("token", "context").agg(F.max("toxic").alias("toxic"), F.max_by("weight", "toxic").alias("weight"))
    by_word = materialize(seen.groupBy("token").agg(F.sum(F.col("toxic") * F.col("weight")).alias("bad"), F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("weight")).alias("square"), F.count("*").alias("n")), "toxicity-words")
    short = [by_word.where(F.length("token") > n).groupBy(F.concat(F.substring("token", 1, n), F.lit("*")).alias("token")).agg(*[F.sum(c).alias(c) for c in ("bad", "all", "square", "n")]) for n in BEGINNINGS]
    out = by_word
    for x in short:
        out = out.unionByName(x)
    return out


def fit_odds(counts: DataFrame, prior: float = 40.0) -> Model:
    """Log-odds of each token's posterior share against the share of all tokens; a chain of Dirichlet priors of weight prior
    leads from that share over the token's beginnings to the token. Weighted counts give the shares; they weigh as
    all^2 / square contexts of equal weight. All tokens and beginnings of the labelled rows are kept."""
    total = counts.where(~F.col("token").endswith("*")).agg(F.sum("bad"), F.sum("all")).first()
    if not total[1] or not total[0] or total[0] == total[1]:
        return Model(np.empty(0, np.int64), np.empty(0))
    share = total[0] / total[1]
    weight = F.col("all") * F.col("all") / F.col("square")
    after = lambda before: (F.col("bad") / F.col("all") * weight + prior * before) / (weight + prior)
    short = F.col("token").endswith("*")
    size = F.length("token") - short.cast("int")
    rows = counts.select("token", "bad", "all", "square", short.alias("short"), size.alias("size"))
    least, most = min(BEGINNINGS), max(BEGINNINGS)
    level = rows.where(F.col("short") & (F.col("size") == least)).select("token", after(F.lit(share)).alias("share"))
    levels = level
    for n in range(least + 1, most + 1):
        before = level.select(F.col("token").alias("_of"), F.col("share").alias("_share"))
        level = rows.where(F.col("short") & (F.col("size") == n)).join(before, F.concat(F.substring("token", 1, n - 1), F.lit("*")) == F.col("_of")).select("token", after(F.col("_share")).alias("share"))
        levels = levels.unionByName(level)
    levels = materialize(levels, "toxicity-beginnings")
    # A word's prior is its longest beginning's, the shortest words' the share of all.
    longest = F.when(F.col("size") > least, F.concat(F.substring(F.col("token"), F.lit(1), F.least(F.col("size") - 1, F.lit(most))), F.lit("*")))
    words = rows.where(~F.col("short")).withColumn("_of", longest).join(levels.select(F.col("token").alias("_of"), F.col("share").alias("_share")), "_of", "left")
    found = words.select("token", after(F.coalesce("_share", F.lit(share))).alias("share")).unionByName(levels)
    kept = F.least(F.greatest(F.col("share"), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.log(kept / (1 - kept)) - math.log(share / (1 - share))
    table = found.select(F.xxhash64("token").alias("code"), odds.alias("odds")).toArrow()
    codes = table["code"].to_numpy()
    order = np.argsort(codes)
    return Model(codes[order], table["odds"].to_numpy()[order])


def sample_bits(id_col: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1_000_000))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 20_000, weight_col: str | None = None) -> Model:
    """Fit on labelled rows (label 0 or 1; others and null texts don't count), at most about max_docs of each label, picked by
    a hash of the id. Rows weigh as many labelled ones as they stand for (weight_col: each as many before), so shares and the
    calibration are those of all labelled rows whatever their number. Four fifths give the log-odds, one fifth the calibration. Labels of one kind only: nothing scores."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("long").alias("toxic"), (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("weight"))
    rows = rows.withColumn("bits", sample_bits("id"))
    found = rows.groupBy("toxic").agg(F.count("*"), F.sum("weight")).collect()
    sizes, whole = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    share = F.when(F.col("toxic") == 1, min(1.0, max_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_docs / max(1, sizes.get(0, 0))))
    # Far beyond the sample the labelled texts are read once more only.
    rows = materialize(rows.where(F.col("bits") < share * 1_000_000).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5))), "toxicity-sample")
    stands = {k: whole[k] / n for k, n in rows.groupBy("toxic").count().collect()}
    rows = rows.withColumn("weight", F.when(F.col("toxic") == 1, stands.get(1, 1.0)).otherwise(stands.get(0, 1.0)))
    model = fit_odds(materialize(count_contexts(rows.where("part <> 0")), "toxicity-counts"))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, size = [], []
            for text in batch.column(0).to_pylist():
                words = ascii_words(text)
                best.append(max((s for _, _, s in maximal_segments(token_scores(model, words))), default=0.0))
                size.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(size, pa.int64()), batch.column(1)], ["best", "size", "toxic"])

    held = bounded_batches(rows.where("part = 0").select("text", "toxic"))
    seen = held.mapInArrow(largest, "best double, size long, toxic long").where("size > 0").toPandas()  # max_docs rows at most
    clean = seen[(seen["toxic"] == 0) & (seen["best"] > 0)]
    model.rate, model.scale = _extreme_law(clean["best"].to_numpy(), clean["size"].to_numpy(float))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [excess(model, text)[0] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    seen = held.mapInArrow(sums, "x double, toxic long").toPandas()
    model.slope, model.bias = _logistic(seen["x"].to_numpy(), seen["toxic"].to_numpy(float), seen["toxic"].map(lambda k: stands.get(k, 1.0)).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """id, score, passages (array of first word, words, expected number, text of every significant segment) for each row of
    docs. Null and wordless texts score as one without segments. Rows repeat as in docs; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for whole in batches:
            for k in range(0, whole.num_rows, 250):
                batch = whole.slice(k, 250)
                scores, found = [], []
                for text in batch.column(1).to_pylist():
                    x, segments = excess(model, text)
                    scores.append(probability(model, x))
                    words = ascii_words(text) if passages and segments else []
                    found.append([{"first_word": lo, "words": hi - lo, "expected": e, "text": " ".join(words[lo:hi])} for lo, hi, e in segments] if passages else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, PASSAGES)], [id_col, "score", "passages"])
        model.memo.clear()
        release()

    kind = dict(docs.dtypes)[id_col]
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, passages array<struct<first_word:bigint,words:bigint,expected:double,text:string>>")


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs' rows whose score is below the threshold, as they are. One pass, no shuffle. Null, empty and wordless texts score as
    one without segments and stay, as their model's bias has it; very long texts count whole; a score at the threshold goes;
    repeated rows are judged alike; an empty table gives none; other columns, whatever their names, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for whole in batches:
            for k in range(0, whole.num_rows, 250):
                batch = whole.slice(k, 250)
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([probability(model, excess(model, x)[0]) < threshold for x in texts], pa.bool_()))
        model.memo.clear()
        release()

    return bounded_batches(docs).mapInArrow(run, docs.schema)


PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("expected", pa.float64()), ("text", pa.string())]))


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder part."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from labels outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(labelled_sample(docs, labels.where(~held_out(3, 1))), weight_col="weight")
    scored = score(docs, model, passages=False)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_docs: int = 20_000) -> DataFrame:
    """docs' labelled rows, at most about max_docs of each label, picked by a hash of the id, and weight: how many of its
    label one stands for. The picked labels are at most
    2 * max_docs rows (about), so they are broadcast and the texts are not shuffled. Ids with differing labels are toxic. Columns
    of docs that are named as the label or weight give way to these; rows of null ids have no label; rows repeat as in docs."""
    docs = docs.drop(label_col, "weight")
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    sizes = dict(one.groupBy(label_col).count().collect())
    picked = None
    for kind, n in sizes.items():
        if kind is None:
            continue
        bits = max(1, int(1_000_000 * min(1.0, max_docs / n)))
        part = one.where((F.col(label_col) == kind) & (sample_bits(id_col) < bits)).withColumn("weight", F.lit(1_000_000 / bits))
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = one.withColumn("weight", F.lit(1.0)).limit(0)
    return docs.join(F.broadcast(picked), id_col)


