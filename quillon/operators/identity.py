"""Identity resolution with look-ups, and what is done with its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scoring, text
from quillon.operators.collaborative import keep_top
from quillon.operators.lineage import cut, parts, shuffled
from quillon.operators.resolve import first_per, match_confidence, repoint

#: Identifiers of editions in the order of their priority.
KINDS = ("isbn13", "isbn10", "volume_id", "asin", "serial_id", "goodreads_id")


def _filed(names: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """gram, name, n: each name under its rarest trigrams only, as many as one of a similar name's must be among."""
    grams = names.select("name", F.explode("grams").alias("gram"), F.size("grams").alias("n")).join(shuffled(counts), "gram")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("df", "gram"))
    return grams.withColumn("_r", rank).where(F.col("_r") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("gram", "name", "n")


def fuzzy_join(asked: DataFrame, known: DataFrame, threshold: float = 0.3) -> DataFrame:
    """X (name of asked), y (name of known), similarity: pairs of trigram similarity of at least threshold (above 0). Both
    sides are distinct names; they meet in rare trigrams only."""
    plain = lambda d: d.select("name").where("name is not null").distinct().withColumn("grams", text.trigrams("name")).where(F.size("grams") > 0)
    a, b = plain(asked), plain(known)
    counts = a.unionByName(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    one = _filed(a, counts, threshold).select("gram", F.col("name").alias("x"), F.col("n").alias("nx"))
    two = _filed(b, counts, threshold).select("gram", F.col("name").alias("y"), F.col("n").alias("ny"))
    near = one.join(shuffled(two), "gram").where(F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9).select("x", "y").distinct()
    return near.withColumn("similarity", text.trigram_similarity("x", "y")).where(F.col("similarity") >= threshold)


def prepared(inputs: DataFrame) -> DataFrame:
    """Inputs with their ISBNs normalised, the plain title q and the kind of path by the identifiers that they have."""
    plain = text.normalize_isbn(F.coalesce("isbn13", "isbn10"))
    rows = inputs.withColumns({"n13": F.when(F.length(plain) == 13, plain).otherwise(text.isbn10_to_13(plain)), "n10": F.when(F.length(plain) == 10, plain), "q": F.trim(F.lower("title"))})
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    kind = F.when(there("isbn13") | there("isbn10"), "isbn").when(there("volume_id"), "gbid").when(there("title") & there("author"), "title").when(there("asin"), "asin").when(there("serial_id"), "royalroad").when(there("goodreads_id"), "goodreads").when(there("title"), "title")
    return rows.withColumn("kind", kind)


def local_by_identifier(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """Id, work_id, edition_id of the smallest edition with an input's identifier (ISBN-13 before ISBN-10). Identifiers of
    both sides are unpivoted, so all kinds are one equi-join."""
    known = editions.select("work_id", "edition_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.upper(F.col(k).cast("string")).alias("value")) for k in KINDS]))).where("value <> ''")
    known = known.groupBy("kind", "value").agg(F.min(F.struct("work_id", "edition_id")).alias("hit"))
    of = {"isbn": ("isbn13", "n13"), "gbid": ("volume_id", "volume_id"), "asin": ("asin", "asin"), "royalroad": ("serial_id", "serial_id"), "goodreads": ("goodreads_id", "goodreads_id")}
    tagged = [F.when(F.col("kind") == kind, F.struct(F.lit(0).alias("p"), F.lit(name).alias("kind"), F.upper(F.col(c).cast("string")).alias("value"))) for kind, (name, c) in of.items()]
    tagged.append(F.when(F.col("kind") == "isbn", F.struct(F.lit(1).alias("p"), F.lit("isbn10").alias("kind"), F.upper("n10").alias("value"))))
    wanted = rows.select("id", F.inline(F.filter(F.array(*tagged), lambda x: x.isNotNull()))).where("value <> ''")
    return wanted.join(shuffled(known), ["kind", "value"]).groupBy("id").agg(F.min_by("hit", F.struct("p", "hit")).alias("hit")).select("id", "hit.work_id", "hit.edition_id")


def local_by_title(rows: DataFrame, works: DataFrame, editions: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """D3: id, work_id, edition_id, confidence of inputs with a title: the `most` rows (work, edition, author) of the most similar
    titles are looked at; ties go to the smaller ids. A title's rows are cut before any are joined with it, and inputs of one
    title and author are looked up once."""
    asked = rows.where("kind = 'title'")
    near = cut(fuzzy_join(asked.select(F.col("q").alias("name")), works.select(F.lower("title").alias("name")), 0.3), "near-titles")
    # A title's rows are as similar as each other, so its first ones alone can count, whatever it is like.
    own = ["work_id", F.col("edition_id").asc_nulls_last(), F.col("name").asc_nulls_last()]
    titled = works.select("work_id", F.lower("title").alias("y")).join(shuffled(near.select("y").distinct()), "y", "left_semi")
    first = cut(keep_top(titled, ["y"], ["work_id"], most), "first-works")
    hits = first.join(shuffled(editions.select("work_id", "edition_id")), "work_id", "left").join(shuffled(names.select("work_id", "name")), "work_id", "left")
    order = [F.round("similarity", 9).desc(), *own]
    top = keep_top(near.join(shuffled(keep_top(hits, ["y"], own, most)), "y"), ["x"], order, most).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(*order)))
    wanted = asked.select("id", "q", F.trim(F.lower("author")).alias("author"))
    both = wanted.select("q", "author").distinct().join(shuffled(top), F.col("q") == F.col("x"))
    both = both.withColumn("like", F.when(F.col("author").isNotNull() & F.col("name").isNotNull(), text.dice_similarity("author", F.lower("name"))))
    hit = F.struct("r", "work_id", "edition_id", "similarity", "like")
    one = both.groupBy("q", "author").agg(F.count("*").alias("n"), F.min_by(hit, "r").alias("best"), F.min_by(F.when(F.col("like") >= 0.7, hit), F.when(F.col("like") >= 0.7, F.col("r"))).alias("by"))
    single = (F.col("n") == 1) & (F.col("best.similarity") >= 0.8)
    use = F.when(single | F.col("by").isNull(), F.col("best")).otherwise(F.col("by"))
    sure = F.when(single, match_confidence(F.col("best.similarity"), None, F.lit(True))).when(F.col("by").isNotNull(), match_confidence(F.col("by.similarity"), F.col("by.like"))).otherwise(match_confidence(F.col("best.similarity")))
    found = one.select(F.col("q").alias("_q"), F.col("author").alias("_author"), use["work_id"].alias("work_id"), use["edition_id"].alias("edition_id"), sure.alias("confidence"))
    return wanted.join(shuffled(found), (F.col("q") == F.col("_q")) & F.col("author").eqNullSafe(F.col("_author"))).select("id", "work_id", "edition_id", "confidence")


def found_outside(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Id and the record that an outside catalogue has for an input. lookup stands for its answers: isbn13, volume_id,
    asked_title, asked_author (what was searched for) and the record's own columns; of several the smallest volume_id."""
    keys = F.array(F.struct(F.lit("isbn").alias("by"), F.col("isbn13").alias("value")), F.struct(F.lit("gbid").alias("by"), F.col("volume_id").alias("value")), F.struct(F.lit("title").alias("by"), F.concat_ws("|", F.lower("asked_title"), F.lower(F.coalesce("asked_author", F.lit("")))).alias("value")))
    record = F.struct(*[F.col(c) for c in ("volume_id", *[x for x in lookup.columns if x not in ("volume_id", "asked_title", "asked_author")])]).alias("record")
    known = lookup.select(F.inline(keys), record).where("value is not null").groupBy("by", "value").agg(F.min_by("record", "record.volume_id").alias("record"))
    search = F.concat_ws("|", F.lower("title"), F.lower(F.coalesce("author", F.lit(""))))
    both = F.col("title").isNotNull() & F.col("author").isNotNull()
    by = F.when(F.col("kind").isin("isbn", "gbid"), F.col("kind")).when((F.col("kind") == "title") | both, "title")
    value = F.when(F.col("kind") == "isbn", F.coalesce("n13", "n10")).when(F.col("kind") == "gbid", F.col("volume_id")).otherwise(search)
    hits = rows.select("id", F.col("title").alias("_title"), by.alias("by"), value.alias("value")).join(shuffled(known), ["by", "value"])
    like = text.dice_similarity(F.lower("_title"), F.lower("record.title"))
    return hits.where((F.col("by") != "title") | (like >= 0.6)).select("id", "record")


def resolve(inputs: DataFrame, works: DataFrame, editions: DataFrame, names: DataFrame, lookup: DataFrame) -> DataFrame:
    """Id, path, confidence, work_id, edition_id (null where a new work is to be made), created, is_stub, lookup_key,
    record (of the outside catalogue, where it was asked and had one). Inputs without any identifier or title fail: they are
    left out. inputs: id, KINDS, title, author; names: work_id, name of authors."""
    rows = cut(prepared(inputs).where("kind is not null").repartition("id"), "prepared")  # identifiers are worked out once
    ids, titles = local_by_identifier(rows, editions), local_by_title(rows, works, editions, names)
    outside = found_outside(rows, lookup)
    t = titles.select("id", F.col("work_id").alias("t_work"), F.col("edition_id").alias("t_edition"), F.col("confidence").alias("sure"))
    all_ = rows.join(shuffled(ids), "id", "left").join(shuffled(t), "id", "left").join(shuffled(outside), "id", "left")
    local, out, sure = F.col("work_id").isNotNull(), F.col("record").isNotNull(), F.coalesce("sure", F.lit(0.0))
    is_ = lambda k: F.col("kind") == k
    by_title = is_("title") & ((sure >= 0.85) | (~out & (sure >= 0.7)))
    path = F.when(is_("isbn"), F.when(local, "isbn_ol").when(out, "isbn_gb").otherwise("isbn_local")).when(is_("title"), F.when(by_title | out, "title_gb").otherwise("manual")).otherwise(F.col("kind"))
    known = F.lit(None).cast("double")
    for name, x in scoring.PATH_CONFIDENCE.items():
        known = F.when(F.col("path") == name, x).otherwise(known)
    stub = scoring.PATH_CONFIDENCE["manual"]
    confidence = F.when(F.col("_by_title"), F.col("sure")).when(is_("gbid") & ~local & ~out, stub).otherwise(known)
    work = F.when(F.col("_by_title"), F.col("t_work")).when(~is_("title"), F.col("work_id"))
    edition = F.when(F.col("_by_title"), F.col("t_edition")).when(~is_("title"), F.col("edition_id"))
    key = text.resolver_key(F.col("isbn13"), F.col("isbn10"), F.col("volume_id"), F.col("asin"), F.col("title"), F.col("author"), F.col("serial_id"), F.col("goodreads_id"))
    done = all_.withColumns({"path": path, "_by_title": by_title}).select("id", "path", confidence.alias("confidence"), work.alias("work_id"), edition.alias("edition_id"), key.alias("lookup_key"), F.when(work.isNull(), F.col("record")).alias("record"))
    created = F.col("work_id").isNull()
    return done.withColumns({"created": created, "is_stub": created & (F.col("confidence") < scoring.STUB_BELOW)})


#: Rows of each side that meet in one group of dice_join; a more frequent bigram's rows are dealt to blocks of about so many.
BLOCK = 1_000
#: Pairs that a task of dice_join brings together.
PAIRS_EACH = 1_000_000


def dice_join(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """X2 for all: word, x (name of asked), y (name of known), similarity: pairs under one word of Dice similarity of at least
    threshold (above 0), all of them. asked, known: word, name, each once, without nulls.

    Prefix filter: a name is filed under its rarest bigrams; of a set of n, any n - ceil(t n / (2 - t)) + 1 hold one of a like
    name's. Positional filter: names that meet in their i-th and j-th rarest share at most 1 + min(bigrams after i, after j) from
    there on. A frequent bigram's rows meet in pairs of blocks. Names without a bigram are like equal ones only."""
    sides = [cut(d.select("word", "name", text.normalize_text("name").alias("plain")), "plain-names") for d in (asked, known)]
    grams = [d.withColumn("grams", text.bigrams(F.col("plain"))).select("word", "name", "plain", F.explode("grams").alias("gram"), F.size("grams").alias("n")) for d in sides]
    counts = cut(grams[0].select("word", "gram").unionByName(grams[1].select("word", "gram")).groupBy("word", "gram").agg(F.count("*").alias("df")), "bigrams")
    rank = F.row_number().over(Window.partitionBy("word", "name").orderBy("df", "gram"))
    kept = F.col("n") - F.ceil(threshold / (2 - threshold) * F.col("n") - 1e-9) + 1
    filed = [cut(g.join(shuffled(counts), ["word", "gram"]).withColumn("r", rank).where(F.col("r") <= kept), "filed") for g in grams]
    met = [f.groupBy("word", "gram").agg(F.count("*").alias(c)) for f, c in zip(filed, ("left", "right"), strict=True)]
    met = cut(met[0].join(shuffled(met[1]), ["word", "gram"]), "blocks")
    n = parts(asked.sparkSession, met.agg(F.sum(F.col("left") * F.col("right"))).first()[0] or 0, PAIRS_EACH)
    blocks = met.select("word", "gram", *[F.floor(F.col(c) / BLOCK).alias(c) for c in ("left", "right")])
    dealt = lambda f, own, other, i, j: f.join(shuffled(blocks), ["word", "gram"]).withColumn(i, F.pmod(F.xxhash64("name"), F.col(own) + 1)).withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other))))
    a = dealt(filed[0], "left", "right", "i", "j").select("word", "gram", "i", "j", F.col("name").alias("x"), F.col("plain").alias("px"), F.col("n").alias("nx"), F.col("r").alias("rx"))
    b = dealt(filed[1], "right", "left", "j", "i").select("word", "gram", "i", "j", F.col("name").alias("y"), F.col("plain").alias("py"), F.col("n").alias("ny"), F.col("r").alias("ry"))
    shared = 1 + F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))
    enough = F.least(shared, F.col("nx"), F.col("ny")) * 2 >= threshold * (F.col("nx") + F.col("ny")) - 1e-9
    met_in = ["word", "gram", "i", "j"]
    pair = ["word", "x", "y", "px", "py"]
    near = a.repartition(n, *met_in).join(shuffled(b.repartition(n, *met_in)), met_in).where(enough).select(*pair)
    short = [d.where(F.length("plain") < 2).select("word", F.col("name").alias(x), F.col("plain").alias(f"p{x}")) for d, x in zip(sides, "xy", strict=True)]
    equal = short[0].join(shuffled(short[1].withColumnRenamed("word", "_word")), (F.col("word") == F.col("_word")) & (F.col("px") == F.col("py"))).select(*pair)
    pairs = near.unionByName(equal).repartition(n, "word", "x", "y").groupBy(*pair).agg(F.count("*").alias("met"))
    # The condition asks for `met`, or the planner would compare a pair wherever it is met.
    like = text.dice_of(F.col("px"), F.col("py"))
    return pairs.where(F.when(F.col("met") > 0, like) >= threshold).select("word", "x", "y", like.alias("similarity"))


def resolve_legacy(inputs: DataFrame, works: DataFrame, names: DataFrame) -> DataFrame:
    """Id, work_id, confidence of the older resolver, by title and author: an equal title (one row: 0.9; a like author: 0.95;
    else 0.7), else the best Dice similarity of at least 0.6 among titles that start with the first word, 0.1 more for a like
    author, accepted from 0.7 on. Ties go to the smaller ids.

    All works of a title and all titles under a word count. Titles and names of authors are compared, each pair once; a title
    stands for its first work, a title and author's name for the first work that has both."""
    titled = works.select("work_id", F.lower("title").alias("name")).where("name is not null")
    by = names.select("work_id", F.lower("name").alias("by"))
    each = inputs.select("id", F.trim(F.lower("title")).alias("q"), F.coalesce(F.trim(F.lower(text.author_name("author"))), F.lit("")).alias("author"))
    asked = cut(each.where("q is not null").select("q", "author").distinct(), "asked")  # a title and author is looked up once
    first = F.min(F.struct("work_id")).alias("first")
    titles = cut(titled.groupBy("name").agg(first), "titles")
    equal = asked.join(shuffled(titles), F.col("q") == F.col("name"), "left_semi")
    rest = cut(asked.join(shuffled(titles), F.col("q") == F.col("name"), "left_anti").withColumn("word", F.get(F.split("q", "\\s+"), F.lit(0))).where(F.length("word") >= 2), "rest")
    # Titles under each of their beginnings that is as long as some input's first word.
    lengths = rest.agg(F.collect_set(F.length("word"))).first()[0]
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length("name")), lambda k: F.substring("name", F.lit(1), k))
    filed = cut(titles.withColumn("word", F.explode(starts)).join(shuffled(rest.select("word").distinct()), "word", "left_semi"), "first-of-word")
    near = dice_join(rest.select("word", F.col("q").alias("name")).distinct(), filed.select("word", "name"), 0.6).withColumnRenamed("x", "q")
    near = cut(near.join(shuffled(filed.select("word", F.col("name").alias("y"), "first")), ["word", "y"]).select("q", F.col("y").alias("name"), "similarity", "first"), "near-titles")
    order = lambda sure, work: F.min(F.struct((-F.round(sure, 9)).alias("far"), work.alias("work")))
    plain = cut(near.groupBy("q").agg(order(F.col("similarity"), F.col("first")).alias("best")), "best-titles")
    # Of the near titles those alone that a like author can bring to the top.
    raised = F.least(F.lit(1.0), F.col("similarity") + 0.1)
    hopeful = near.join(shuffled(plain), "q").where(F.round(raised, 9) >= -F.col("best.far")).select("q", "name", raised.alias("sure"))
    hopeful = rest.select("q", "author").where("author <> ''").join(shuffled(hopeful), "q")
    wanted = cut(equal.select(F.col("q").alias("name"), "author").unionByName(hopeful.select("name", "author")).distinct(), "wanted")
    held = titled.join(shuffled(wanted.select("name").distinct()), "name", "left_semi").join(shuffled(by), "work_id", "left").groupBy("name", "by").agg(first, F.count("*").alias("n"))
    held = cut(held, "title-authors")
    alike = dice_join(wanted.where("author <> ''").select(F.lit("").alias("word"), F.col("author").alias("name")).distinct(), held.where("by is not null").select(F.lit("").alias("word"), F.col("by").alias("name")).distinct(), 0.7)
    alike = cut(alike.select(F.col("x").alias("author"), F.col("y").alias("by"), F.col("similarity").alias("like")), "like-authors")
    liked = held.join(shuffled(alike), "by").groupBy("name", "author").agg(F.min(F.when(F.col("like") >= 0.8, F.col("first"))).alias("surely"), F.min("first").alias("liked"))
    liked = cut(wanted.join(shuffled(liked), ["name", "author"]), "liked")
    rows = held.groupBy("name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    one = equal.select(F.col("q").alias("name"), "author").join(shuffled(rows), "name").join(shuffled(liked), ["name", "author"], "left")
    exact = one.select(F.col("name").alias("q"), "author", F.when((F.col("n") > 1) & F.col("surely").isNotNull(), F.col("surely")).otherwise(F.col("first"))["work_id"].alias("work_id"), F.when(F.col("n") == 1, 0.9).when(F.col("surely").isNotNull(), 0.95).otherwise(0.7).alias("confidence"))
    boosted = hopeful.join(shuffled(liked), ["name", "author"]).groupBy("q", "author").agg(order(F.col("sure"), F.col("liked")).alias("raised"))
    best = rest.select("q", "author").join(shuffled(plain), "q").join(shuffled(boosted), ["q", "author"], "left").select("q", "author", F.least("best", "raised").alias("x"))
    fuzzy = best.where("x.far <= -0.7").select("q", "author", "x.work.work_id", (-F.col("x.far")).alias("confidence"))
    return each.join(shuffled(exact.unionByName(fuzzy)), ["q", "author"]).select("id", "work_id", "confidence")


def new_id(key: Column) -> Column:
    """Id of a work that is made for a resolver's key: the same key, the same work, in any run and on any task."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 62)) + F.lit(1 << 61)


def upsert_works(works: DataFrame, resolved: DataFrame, inputs: DataFrame) -> DataFrame:
    """Works (work_id, title, description, first_publish_year, is_stub) after resolution: found ones get what they lack, new
    ones are made, one for each key. inputs: id, title, description, published. Of several inputs for a work the smallest id."""
    data = resolved.join(shuffled(inputs.select("id", "title", "description", "published")), "id").withColumn("work_id", F.coalesce("work_id", new_id(F.col("lookup_key"))))
    fresh = first_per(data, ["work_id"], ["id"]).select(
        F.col("work_id").alias("n_id"), F.coalesce("record.title", "title").alias("n_title"), F.coalesce("record.description", "description").alias("n_description"),
        text.year_of(F.coalesce("record.published", "published")).alias("n_year"), F.col("is_stub").alias("n_stub"),
    )
    both = works.join(fresh, F.col("work_id") == F.col("n_id"), "full")
    title = F.coalesce("title", "n_title", F.lit("Unknown Title"))
    return both.select(F.coalesce("work_id", "n_id").alias("work_id"), title.alias("title"), F.coalesce("description", "n_description").alias("description"), F.coalesce("first_publish_year", "n_year").alias("first_publish_year"), F.coalesce("is_stub", "n_stub").alias("is_stub"))


def upsert_editions(editions: DataFrame, resolved: DataFrame, inputs: DataFrame) -> DataFrame:
    """Editions (edition_id, work_id, KINDS) after resolution: a found one gets the identifiers that it lacks, and each new
    work has an edition with those of its input (and of the outside record)."""
    data = resolved.join(shuffled(inputs.select("id", *KINDS)), "id").withColumn("work_id", F.coalesce("work_id", new_id(F.col("lookup_key")))).withColumn("edition_id", F.coalesce("edition_id", "work_id"))
    pick = {k: F.coalesce(F.col(f"record.{k}"), F.col(k)) if k in ("isbn13", "isbn10", "volume_id") and k in resolved.schema["record"].dataType.names else F.col(k) for k in KINDS}
    fresh = first_per(data, ["edition_id"], ["id"]).select(F.col("edition_id").alias("n_id"), F.col("work_id").alias("n_work"), *[x.alias(f"n_{k}") for k, x in pick.items()])
    both = editions.join(fresh, F.col("edition_id") == F.col("n_id"), "full")
    return both.select(F.coalesce("edition_id", "n_id").alias("edition_id"), F.coalesce("work_id", "n_work").alias("work_id"), *[F.coalesce(k, f"n_{k}").alias(k) for k in KINDS])


def link_names(work_author: DataFrame, authors: DataFrame, named: DataFrame, fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Authors and pairs of works and authors after some works (work_id, authors: a text of names) were given theirs. A
    name is an author's if it is equal (fold: but for case); other names become new authors."""
    key = (lambda c: F.lower(c)) if fold else (lambda c: F.col(c))
    names = named.select("work_id", F.explode(text.split_authors("authors")).alias("new_name")).distinct()
    known = authors.groupBy(key("name").alias("k")).agg(F.min("author_id").alias("author_id"))
    both = names.withColumn("k", key("new_name")).join(known, "k", "left").withColumn("author_id", F.coalesce("author_id", new_id(F.concat(F.lit("author:"), "k"))))
    made = both.join(authors.select("author_id"), "author_id", "left_anti").groupBy("author_id").agg(F.min("new_name").alias("name"))
    return authors.unionByName(made.select("author_id", "name")), work_author.unionByName(both.select("work_id", "author_id")).distinct()


def merge_all(merges: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after works were merged (from_id, to_id, reason; transitive already). edition: all move. work_author and
    work_subject: moved, without doubles. user_event: moved unless the remaining work has one of that reader and source. rating:
    moved, a merged work's figures take the place of the remaining one's for that source, with the later date. work: what
    remains gets a missing description and year and is no stub any more; merged ones go. log: one row for each merge. Of several
    works merged into one the larger id counts last, as if merged in that order. resolver_cache and resolver_log, where they are
    given, are re-pointed; a work_author row is an author in a role, if it has one."""
    m = merges.select("from_id", "to_id")
    out = {name: repoint(tables[name], m) for name in ("edition", "resolver_cache", "resolver_log") if name in tables}
    for name in ("work_author", "work_subject"):
        out[name] = repoint(tables[name], m).distinct()
    was = F.col("_was")
    moved = repoint(tables["user_event"].withColumn("_was", F.col("work_id")), m)
    out["user_event"] = first_per(moved, ["user_id", "work_id", "source"], [F.when(was == F.col("work_id"), 0).otherwise(1), was]).drop("_was")
    r = repoint(tables["rating"].withColumn("_was", F.col("work_id")), m).withColumn("_last", F.max("last_updated").over(Window.partitionBy("work_id", "source")))
    out["rating"] = first_per(r, ["work_id", "source"], [F.when(was == F.col("work_id"), 1).otherwise(0), was.desc()]).withColumn("last_updated", F.col("_last")).drop("_was", "_last")
    into = tables["work"].join(m, F.col("work_id") == F.col("from_id")).groupBy("to_id").agg(F.min_by("description", F.when(F.col("description").isNotNull(), F.col("from_id"))).alias("d"), F.min_by("first_publish_year", F.when(F.col("first_publish_year").isNotNull(), F.col("from_id"))).alias("y"))
    kept = tables["work"].join(m.select(F.col("from_id").alias("work_id")), "work_id", "left_anti").join(into, F.col("work_id") == F.col("to_id"), "left")
    filled = {"description": F.coalesce("description", "d"), "first_publish_year": F.coalesce("first_publish_year", "y"), "is_stub": F.col("is_stub") & F.col("to_id").isNull()}
    out["work"] = kept.withColumns(filled).select(*tables["work"].columns)
    counts = tables["edition"].groupBy(F.col("work_id").alias("from_id")).agg(F.count("*").alias("editions_moved"))
    out["log"] = merges.join(counts, "from_id", "left").select("from_id", "to_id", "reason", F.coalesce("editions_moved", F.lit(0)).alias("editions_moved"))
    return out


def merge_history(log: DataFrame, work_id: int) -> DataFrame:
    """What was merged into a work, the newest first. log: from_id, to_id, reason, merged_at."""
    return log.where(F.col("to_id") == work_id).select("from_id", "reason", "merged_at").orderBy(F.col("merged_at").desc(), "from_id")


def enrich(works: DataFrame, editions: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """Works and editions after outside records (work_id, description, published, cover_url, volume_id, page_count) were put
    in where something is missing. A work that got a description, or a cover where it had none, is no stub any more."""
    one = first_per(found, ["work_id"], ["volume_id"])
    r = one.select("work_id", F.col("description").alias("r_d"), text.year_of("published").alias("r_y"), F.col("cover_url").alias("r_c"), F.col("volume_id").alias("r_v"), F.col("page_count").alias("r_p"))
    covered = editions.groupBy("work_id").agg(F.max(F.col("cover_url").isNotNull()).alias("has_cover"))
    w = works.join(r, "work_id", "left").join(covered, "work_id", "left")
    better = (F.col("description").isNull() & F.col("r_d").isNotNull()) | (~F.coalesce("has_cover", F.lit(False)) & F.col("r_c").isNotNull())
    w = w.withColumns({"is_stub": F.col("is_stub") & ~F.coalesce(better, F.lit(False)), "description": F.coalesce("description", "r_d"), "first_publish_year": F.coalesce("first_publish_year", "r_y")}).select(*works.columns)
    e = editions.join(r, "work_id", "left").join(covered, "work_id", "left")
    fill = ~F.coalesce("has_cover", F.lit(False)) & F.col("r_c").isNotNull()
    put = lambda old, new: F.when(fill, F.coalesce(old, new)).otherwise(F.col(old))
    e = e.withColumns({"cover_url": put("cover_url", "r_c"), "volume_id": put("volume_id", "r_v"), "page_count": put("page_count", "r_p")}).select(*editions.columns)
    return {"work": w, "edition": e}


def add_subjects(work_subject: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of works and subjects with the categories (array) of outside records, as strict subject keys."""
    more = found.select("work_id", F.explode("categories").alias("c")).select("work_id", text.subject_key("c", True).alias("subject")).where("subject <> ''")
    return work_subject.unionByName(more).distinct()


def add_ratings(rating: DataFrame, found: DataFrame, source: str = "googlebooks") -> DataFrame:
    """Ratings after those of outside records (avg, n; both above 0) took the place of the source's."""
    new = found.where("avg > 0 and n > 0").groupBy("work_id").agg(F.max(F.struct("n", "avg")).alias("x")).select("work_id", F.lit(source).alias("source"), "x.avg", "x.n")
    return rating.join(new.select("work_id", "source"), ["work_id", "source"], "left_anti").select("work_id", "source", "avg", "n").unionByName(new.select("work_id", "source", "avg", "n"))


def not_imported(rows: DataFrame, editions: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of a library export none of whose ISBNs is one of an edition that the reader (events: work_id) has already."""
    have = editions.join(events.select("work_id").distinct(), "work_id", "left_semi").select(F.explode(F.array("isbn13", "isbn10")).alias("isbn")).where("isbn is not null").distinct()
    mine = rows.select("book_id", F.explode(F.array("isbn13", "isbn10")).alias("isbn")).where("isbn is not null")
    return rows.join(mine.join(have, "isbn", "left_semi").select("book_id").distinct(), "book_id", "left_anti")


def import_library(rows: DataFrame, events: DataFrame, works: DataFrame, editions: DataFrame, names: DataFrame, lookup: DataFrame) -> DataFrame:
    """book_id, step, work_id of the lines of a library export: `skipped` (imported before), `isbn` (resolved by the batch of
    ISBNs), `resolver` (by the resolver, whose new works have the id of their key)."""
    fresh = not_imported(rows, editions, events)
    skipped = rows.join(fresh.select("book_id"), "book_id", "left_anti").select("book_id", F.lit("skipped").alias("step"), F.lit(None).cast("long").alias("work_id"))
    known = editions.select("work_id", F.inline(F.array(F.struct(F.lit(0).alias("p"), F.col("isbn13").alias("isbn")), F.struct(F.lit(1).alias("p"), F.col("isbn10").alias("isbn"))))).where("isbn is not null").groupBy("isbn").agg(F.min("work_id").alias("work_id"))
    wanted = fresh.select("book_id", F.inline(F.array(F.struct(F.lit(0).alias("p"), F.col("isbn13").alias("isbn")), F.struct(F.lit(1).alias("p"), F.col("isbn10").alias("isbn"))))).where("isbn is not null")
    batch = wanted.join(known, "isbn").groupBy("book_id").agg(F.min_by("work_id", F.struct("p", "work_id")).alias("work_id")).select("book_id", F.lit("isbn").alias("step"), "work_id")
    rest = fresh.join(batch.select("book_id"), "book_id", "left_anti")
    none = F.lit(None).cast("string")
    asked = rest.select(F.col("book_id").alias("id"), "isbn13", "isbn10", none.alias("volume_id"), none.alias("asin"), none.alias("serial_id"), F.col("book_id").cast("string").alias("goodreads_id"), "title", "author")
    done = resolve(asked, works, editions, names, lookup).select(F.col("id").alias("book_id"), F.lit("resolver").alias("step"), F.coalesce("work_id", new_id(F.col("lookup_key"))).alias("work_id"))
    return skipped.unionByName(batch).unionByName(done)


def resolve_asins(asins: DataFrame, editions: DataFrame) -> DataFrame:
    """Asin (upper case), work_id, title of distinct items (asin, title): the work of the edition that has it, or null; an
    item without a title is named by its asin."""
    one = asins.select(F.upper("asin").alias("asin"), "title").where("asin <> ''").groupBy("asin").agg(F.min("title").alias("title"))
    known = editions.select(F.upper("asin").alias("asin"), "work_id").where("asin is not null").groupBy("asin").agg(F.min("work_id").alias("work_id"))
    return one.join(known, "asin", "left").select("asin", "work_id", F.coalesce("title", "asin").alias("title"))
