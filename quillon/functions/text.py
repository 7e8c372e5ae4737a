
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trigrams(x: Column | str) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(col(x)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def overlap(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; null for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """X1."""
    return overlap(trigrams(a), trigrams(b))


def normalize_text(x: Column | str) -> Column:
    """Lower case, anything but ASCII word characters to a space, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9_\\s]", " "), "\\s+", " "))


def bigrams(x: Column) -> Column:
    n = F.length(x)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(x, k, F.lit(2)))))


def dice_similarity(a: Column | str, b: Column | str) -> Column:
    """Twice the shared bigrams over both numbers of bigrams; 1 for equal normalised texts, 0 for short ones."""
    return dice_of(normalize_text(a), normalize_text(b))


def dice_of(x: Column, y: Column) -> Column:
    """X2 of texts that are normalised already: columns of rows, as an expression would be worked out for each bigram."""
    p, q = bigrams(x), bigrams(y)
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(p, q)) / (F.size(p) + F.size(q)))


def truncate_text(x: Column | str, n: int, suffix: str = "...") -> Column:
    """X4."""
    x = col(x)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.trim(F.substring(x, 1, n - len(suffix))), F.lit(suffix)))


def embedding_text(title, subtitle, authors, description, subjects) -> Column:
    """Title, subtitle, authors, description up to 2,000 characters, the first 10 subjects; empty parts are left out."""
    some = lambda x: F.when(F.length(x) > 0, x)
    by = F.when(F.size(authors) > 0, F.concat(F.lit("By "), F.array_join(authors, ", ")))
    topics = F.when(F.size(subjects) > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice(subjects, 1, 10), ", ")))
    return F.concat_ws(". ", some(title), some(subtitle), by, some(truncate_text(description, 2000)), topics)


def year_of(x: Column | str, pattern: str = "\\b(?:19|20)\\d{2}\\b") -> Column:
    """The first year in a text, or null."""
    return F.nullif(F.regexp_extract(col(x), f"({pattern})", 1), F.lit("")).cast("int")


#: The wider variant of dumps.
DUMP_YEAR = "\\b(?:1[0-9]{3}|20[0-2][0-9])\\b"


#: The forms of dates that are read whole before a year is looked for.
DATE_FORMS = ("yyyy-MM-dd", "yyyy-MM", "MMMM d, yyyy", "MMMM yyyy", "d MMMM yyyy", "yyyy")


def date_year(x: Column | str) -> Column:
    """The year of a date in one of DATE_FORMS, else the first year in the text, or null."""
    whole = [F.year(F.try_to_timestamp(F.trim(col(x)), F.lit(form))) for form in DATE_FORMS]
    return F.coalesce(*whole, year_of(x))


def normalize_isbn(x: Column | str) -> Column:
    """Hyphens and spaces removed; null unless 10 or 13 characters are left."""
    plain = F.upper(F.regexp_replace(col(x), "[-\\s]", ""))
    return F.when(F.length(plain).isin(10, 13), plain)


def isbn10_to_13(x: Column | str) -> Column:
    """Prefix 978 and a check digit with weights 1 and 3."""
    body = F.concat(F.lit("978"), F.substring(col(x), 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda acc, k: acc + F.substring(body, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 3).otherwise(1))
    return F.when(col(x).rlike("^[0-9]{9}[0-9X]$"), F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string")))


def slugify(x: Column | str) -> Column:
    """X8."""
    plain = F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-")
    return F.regexp_replace(plain, "^-+|-+$", "")


def author_name(x: Column | str) -> Column:
    """X8: 'Last, First' to 'First Last'."""
    parts = F.split(col(x), ",\\s*")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(F.trim(col(x)))


def key_suffix(x: Column | str) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(col(x), "[^/]+$", 0)


def subject_key(x: Column | str, strict: bool = False) -> Column:
    """Lower case, white space to one underscore; strict also drops all but a-z, 0-9 and underscores."""
    plain = F.regexp_replace(F.lower(col(x)), "\\s+", "_")
    return F.regexp_replace(plain, "[^a-z0-9_]", "") if strict else plain


def dedupe_title(x: Column | str) -> Column:
    """X11: without a trailing bracket, a subtitle and a volume mark, lower case."""
    plain = F.regexp_replace(col(x), "\\s*\\([^)]*\\)\\s*$", "")
    plain = F.regexp_replace(plain, ":.*$", "")
    return F.trim(F.regexp_replace(F.lower(plain), "\\s*(?:book\\s+[0-9]+|#[0-9]+|volume\\s+[0-9]+)\\s*$", ""))


def cross_source_title(x: Column | str) -> Column:
    """A title without all brackets at its end, a subtitle after a colon, and a volume mark in any case; lower case."""
    plain = F.regexp_replace(col(x), "\\s*\\([^)]*\\)\\s*$", "")
    plain = F.regexp_replace(plain, "\\s*:.*$", "")
    return F.lower(F.regexp_replace(plain, "(?i)\\s*(?:Book\\s*\\d+|#\\d+|Volume\\s*\\d+)\\s*$", ""))


def html_to_text(x: Column | str) -> Column:
    """Breaks and paragraph ends to line ends, tags dropped, entities decoded with &amp; first, white space reduced."""
    x = F.regexp_replace(col(x), "(?i)<br\\s*/?>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "(?i)</p>", "\n\n"), "<[^>]+>", "")
    # Entities in the order of decoding.
    for name, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(to))
    return F.btrim(F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def url_host(x: Column | str) -> Column:
    """Host without www., lower case; null for what is no URL."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(col(x), "^https?://([^/?#:]+)", 1)), "^www\\.", ""), F.lit(""))


def url_path(x: Column | str) -> Column:
    return F.regexp_extract(col(x), "^https?://[^/?#]+([^?#]*)", 1)


def url_param(x: Column | str, name: str) -> Column:
    return F.nullif(F.regexp_extract(col(x), f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def cover_url(cover_id, isbn13, isbn10, edition_key, work_key, volume_id, size: str = "M") -> Column:
    """The first there is of cover id, ISBNs, edition key, work key and volume id."""
    at = "https://covers.openlibrary.org"
    one = lambda kind, x: F.when(F.length(x.cast("string")) > 0, F.concat(F.lit(f"{at}/{kind}/"), x.cast("string"), F.lit(f"-{size}.jpg")))
    zoom = {"S": 0, "M": 1}.get(size, 2)
    volume = F.when(F.length(volume_id) > 0, F.concat(F.lit("https://books.google.com/books/content?id="), volume_id, F.lit(f"&printsec=frontcover&img=1&zoom={zoom}")))
    return F.coalesce(one("b/id", cover_id), one("b/isbn", isbn13), one("b/isbn", isbn10), one("b/olid", edition_key), one("w/olid", work_key), volume)


def split_authors(x: Column | str) -> Column:
    """At commas and ampersands, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(x), "[,&]"), lambda w: F.trim(w)), lambda w: w != "")


#: Shelf names of library exports and status names of reading logs.
SHELVES = {"read": "read", "currently-reading": "currently-reading", "to-read": "to-read", "dnf": "dnf", "did-not-finish": "dnf"}
STATUSES = {"already-read": "already-read", "read": "already-read", "currently-reading": "currently-reading", "reading": "currently-reading", "want-to-read": "want-to-read", "want": "want-to-read", "to-read": "want-to-read"}


def mapped(x: Column | str, names: dict[str, str], default: str | None = None) -> Column:
    """Name by name; default for the others."""
    out = F.lit(default)
    for a, b in names.items():
        out = F.when(F.lower(F.trim(col(x))) == a, b).otherwise(out)
    return out


def short_number(x: Column | str) -> Column:
    """1.2M, 1.2k."""
    x = col(x)
    return F.when(x >= 1_000_000, F.concat(F.format_string("%.1f", x / 1_000_000), F.lit("M"))).when(x >= 1000, F.concat(F.format_string("%.1f", x / 1000), F.lit("k"))).otherwise(x.cast("string"))


def hours_text(hours: Column | str) -> Column:
    """12h, 1.5h, or minutes (1m at least) below an hour, halves rounded up. A double of 1 to 10 is a whole number of
    2^-52, so its tenths are exact: 3.15, which lies below three and fifteen hundredths, is 3.1h."""
    h = col(hours)
    whole = lambda x: F.floor(x + 0.5).cast("string")
    tenths = F.shiftright((F.least(h, F.lit(10.0)) * float(1 << 52)).cast("long") * 10 + (1 << 51), 52)
    some = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.when(h >= 10, F.concat(whole(h), F.lit("h"))).when(h >= 1, F.concat(some, F.lit("h"))).otherwise(F.concat(whole(F.greatest(h * 60, F.lit(1.0))), F.lit("m")))


def title_case(x: Column | str) -> Column:
    """A slug or subject for reading."""
    return F.initcap(F.regexp_replace(col(x), "[-_]+", " "))


def parse_year_range(text: str) -> tuple[int | None, int | None]:
    """X18: '1980-', '-2020', '1950-2000'."""
    low, _, high = text.partition("-")
    return int(low) if low.strip() else None, int(high) if high.strip() else None


def anchors_hash(ids: Column) -> Column:
    """12 characters of the MD5 of sorted ids."""
    return F.substring(F.md5(F.array_join(F.array_sort(ids), ",").cast("binary")), 1, 12)


def string_hash(x: Column | str) -> Column:
    """H * 31 + unit over the text's UTF-16 units, as a signed 32-bit number; 0 for an empty text."""
    def wrap(v: Column) -> Column:
        return F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    def step(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(point - 0x10000, 10), F.lit(0xDC00) + point.bitwiseAND(F.lit(0x3FF))
        return F.when(point > 0xFFFF, wrap(wrap(h * 31 + high) * 31 + low)).otherwise(wrap(h * 31 + point))

    chars = F.filter(F.split(col(x), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), step).cast("int")


def cache_key(x: Column | str) -> Column:
    """32 characters of the SHA-256."""
    return F.substring(F.sha2(col(x).cast("binary"), 256), 1, 32)


def resolver_key(isbn13, isbn10, volume, asin, title, author, serial=None, goodreads=None) -> Column:
    """The first identifier there is, by priority, else title and author."""
    tag = lambda name, x: F.when(F.length(x.cast("string")) > 0, F.concat(F.lit(name + ":"), x.cast("string")))
    some = [tag("isbn13", isbn13), tag("isbn10", isbn10), tag("gbid", volume), tag("asin", F.upper(asin))]
    some += [tag(name, x) for name, x in (("rr", serial), ("gr", goodreads)) if x is not None]
    plain = lambda x: F.trim(F.lower(F.coalesce(x, F.lit(""))))
    return F.coalesce(*some, F.when(F.length(title) > 0, F.concat(F.lit("title:"), plain(title), F.lit("|author:"), plain(author))))


def external_ids(url: Column | str) -> Column:
    """Asin, goodreads_id, serial_id, volume_id that an address of a shop or catalogue holds; nulls where it has none."""
    host, path = url_host(url), url_path(url)
    one = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    shop = (host == "amazon.com") | host.endswith(".amazon.com")
    asked = url_param(url, "asin")
    asin = F.upper(F.coalesce(one("(?i)/(?:dp|gp/product)/([A-Z0-9]{10})"), F.when(is_asin(asked), asked)))
    books = host.contains("google.com") & (path.contains("/books") | host.startswith("books."))
    ids = {"asin": F.when(shop, asin), "goodreads_id": F.when(host == "goodreads.com", one("/book/show/([0-9]+)")), "serial_id": F.when(host == "royalroad.com", one("/fiction/([0-9]+)")), "volume_id": F.when(books, url_param(url, "id"))}
    return F.struct(*[v.alias(k) for k, v in ids.items()])


def is_asin(x: Column | str) -> Column:
    """Ten letters and digits."""
    return col(x).rlike("(?i)^[A-Z0-9]{10}$")


def is_book_asin(x: Column | str) -> Column:
    """An item's number of the shop's own, which starts with B."""
    return col(x).rlike("(?i)^B[A-Z0-9]{9}$")


def first_external_id(url: Column | str) -> Column:
    """Type and value of the first id of an address, or null."""
    ids = external_ids(url)
    each = [F.when(ids[k].isNotNull(), F.struct(F.lit(k).alias("type"), ids[k].alias("value"))) for k in ("asin", "goodreads_id", "serial_id", "volume_id")]
    return F.coalesce(*each)


def external_url(kind: str, value: Column | str) -> Column:
    """The address of an item by its id."""
    x = F.upper(col(value)) if kind == "asin" else F.url_encode(col(value)) if kind == "volume_id" else col(value)
    return F.concat(F.lit(EXTERNAL_URLS[kind]), x.cast("string"))


#: Beginnings of addresses by the kind of id.
EXTERNAL_URLS = {"asin": "https://www.amazon.com/dp/", "goodreads_id": "https://www.goodreads.com/book/show/", "serial_id": "https://www.royalroad.com/fiction/", "volume_id": "https://books.google.com/books?id="}


def unwrap_isbn(x: Column | str) -> Column:
    """The content of ="..." cells; null if empty."""
    return F.nullif(F.regexp_replace(col(x), '^="?|"?$', ""), F.lit(""))


def unwrap_text(json: Column, field: str) -> Column:
    """A JSON field that is a text or an object with a value."""
    raw = F.get_json_object(json, f"$.{field}")
    return F.when(raw.startswith("{"), F.get_json_object(raw, "$.value")).otherwise(raw)


def clamped_int(x: Column | str, default: int, most: int) -> Column:
    """A positive integer up to most, else the default."""
    n = F.expr(f"try_cast({x} as int)") if isinstance(x, str) else x
    return F.when(n > 0, F.least(n, F.lit(most))).otherwise(default)


def tsv_escape(x: Column | str) -> Column:
    """X29."""
    x = F.replace(col(x), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
