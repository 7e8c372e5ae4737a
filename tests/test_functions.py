from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scoring, text, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_trigrams(spark):
    a = one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words")), text.trigram_similarity(F.lit("a"), F.lit("A")), text.trigram_similarity(F.lit(""), F.lit("")))
    assert a[0] == pytest.approx(4 / 11) and a[1] == 1.0 and a[2] is None


def test_dice(spark):
    assert one(spark, text.dice_similarity(F.lit("Night!"), F.lit("night")), text.dice_similarity(F.lit("night"), F.lit("nacht")), text.dice_similarity(F.lit("a"), F.lit("b"))) == (1.0, 0.25, 0.0)


def test_isbn(spark):
    assert one(spark, text.isbn10_to_13(text.normalize_isbn(F.lit("0-306-40615-2"))), text.normalize_isbn(F.lit("12")), text.unwrap_isbn(F.lit('="0306406152"')), text.unwrap_isbn(F.lit('=""'))) == ("9780306406157", None, "0306406152", None)


def test_texts(spark):
    got = one(
        spark, text.normalize_text(F.lit(" Élan, vital!  x ")), text.truncate_text(F.lit("abcdef ghij"), 10), text.slugify(F.lit("Hard Sci-Fi!")), text.author_name(F.lit("Doe, Jane")),
        text.dedupe_title(F.lit("A Tale: of two (Series #1)")), text.html_to_text(F.lit("<p>a&amp;lt;b<br/>c</p>")), text.short_number(F.lit(1_200_000)), text.key_suffix(F.lit("/works/OL1W")),
    )
    assert got == ("lan vital x", "abcdef...", "hard-sci-fi", "Jane Doe", "a tale", "a<b\nc", "1.2M", "OL1W")


def test_embedding_text(spark):
    got = one(spark, text.embedding_text(F.lit("T"), F.lit(None).cast("string"), F.array(F.lit("A"), F.lit("B")), F.lit("d"), F.array(F.lit("s"))))
    assert got == ("T. By A, B. d. Topics: s",)


def test_year_ranges():
    assert [text.parse_year_range(x) for x in ("1980-", "-2020", "1950-2000")] == [(1980, None), (None, 2020), (1950, 2000)]


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    got = one(spark, vectors.cosine(a, b), vectors.cosine(a, z), vectors.normalized(a), vectors.normalized(z), vectors.encode(a), vectors.decode(F.lit("[1.5,2]")), vectors.cosine(a, F.array(F.lit(1.0))))
    assert got[0] == pytest.approx(0.96) and got[1] == 0.0 and got[2] == [0.6, 0.8] and got[3] == [0.0, 0.0] and got[4] == "[3.000000,4.000000]" and got[5] == [1.5, 2.0] and got[6] is None


def test_rating_multiplier(spark):
    got = one(spark, *[scoring.rating_multiplier(F.lit(r)) for r in (1, 2, 3, 4, 5)])
    assert got == pytest.approx((0.5, math.sqrt(0.5), 1.0, math.sqrt(2), 4.0))


def test_wilson_and_grades(spark):
    got = one(spark, scoring.wilson(F.lit(1.0), F.lit(10)), scoring.wilson(F.lit(0.5), F.lit(0)), scoring.grade(F.lit(0.75)), scoring.grade(F.lit(0.1)), scoring.browse_grade(F.lit(4.6), F.lit(4)))
    assert got[0] == pytest.approx(10 / (10 + 1.96**2)) and got[1:] == (0.0, "A", "B-", "B-")


def test_reasons(spark):
    none = F.lit(None).cast("string")
    got = one(spark, scoring.quick_reasons(none, F.lit(0.5), F.lit(0.5)), scoring.quick_reasons(F.lit("X"), F.lit(0.9), F.lit(0.9)))
    assert got == ([scoring.REASON_OTHER], ['Similar to "X" which you enjoyed', scoring.REASON_MATCH])


def test_keys_numbers_and_escapes(spark):
    import hashlib

    got = one(spark, text.anchors_hash(F.array(F.lit("3"), F.lit("12"))), text.cache_key(F.lit("q")), text.clamped_int(F.lit(7), 20, 5), text.clamped_int(F.lit(-1), 20, 50), text.tsv_escape(F.lit("a\tb\nc\\d\r")))
    assert got == (hashlib.md5(b"12,3").hexdigest()[:12], hashlib.sha256(b"q").hexdigest()[:32], 5, 20, "a\\tb\\nc\\\\d\\r")


def test_tables_are_replaced_and_upserted_from_a_stream(spark, tmp_path):
    from quillon.sources import sinks
    from quillon.streaming import sessions

    sinks.replace_table(spark.range(5), str(tmp_path / "t"))
    sinks.replace_table(spark.range(2), str(tmp_path / "t"))
    sinks.append(spark.range(2, 3), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1, 2]
    seen = []
    query = sessions.upsert_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "t")), lambda batch, number: seen.extend(r[0] for r in batch.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [0, 1, 2]


def test_hours_years_and_hashes(spark):
    """Halves of exact binary values go up; dates in whole forms before years in texts; a hash over UTF-16 units."""
    from decimal import ROUND_HALF_UP, Decimal

    def shown(h):
        fixed = lambda x, n: Decimal(x).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)
        return f"{fixed(h, 0)}h" if h >= 10 else f"{fixed(h, 1)}h" if h >= 1 else f"{fixed(max(h * 60, 1.0), 0)}m"

    hours = [k / 40 for k in range(800)] + [3.15, 1.25, 9.95, 9.999, 10.5, 0.0, 0.001, 12345.5]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hours], "h double").select(text.hours_text("h")).collect()]
    assert got == [shown(h) for h in hours]

    def hashed(s):
        h = 0
        units = s.encode("utf-16-le")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "little") + 2**31) % 2**32 - 2**31
        return h

    texts = ["", "a", "hello world", "é日𝒳😀", "x" * 500, "\n\t"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.string_hash("t")).collect()] == [hashed(t) for t in texts]
    dates = ["1985-03-02", "1850-01-01", "March 5, 1850", "May 1985", "7 June 1799", "c1850", "c. 1950?", "1066", None, "", "x 2001 y"]
    years = [1985, 1850, 1850, 1985, 1799, None, 1950, 1066, None, None, 2001]
    assert [r[0] for r in spark.createDataFrame([(d,) for d in dates], "d string").select(text.date_year("d")).collect()] == years
