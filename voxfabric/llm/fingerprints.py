"""Document fingerprints: Order MinHash, by DataFrame functions alone.

A text's k-mers of code points are numbered by occurrence, so that the second
"abc" differs from the first, and each numbered k-mer gets a random 32-bit
rank. The ranks fall into bins by their first bits; of each bin the least
numbered k-mers are taken, put in the order in which they stand in the text,
and hashed as a tuple. Two texts agree in a bin if they share its k-mers in
the same order, which makes the likeness follow the edit distance and not the
set of k-mers alone.

All of it runs inside a row on arrays of longs (a k-mer's hash above its
place), at a few sorts and passes a text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.llm.common import cut, stored, text_column

K = 8
BINS_BITS = 5
TUPLE = 2  # as the entries are made for two
#: Ranks of a bin that are sorted at first, on average; where they are too few, the text is sorted whole.
LIKELY = 12
_PLACE_BITS = 31  # a string has fewer characters
_BIN_SHIFT = _PLACE_BITS + 32 - BINS_BITS
#: Added to the place of a k-mer that the edited text alone has; a text of so many code points would not fit into a row.
_ONLY_EDITED = 1 << 30
_RANKED = ("__s", "__w", "__n", "__near")


def _kmers(text: Column, k: int) -> Column:
    """Every run of k code points; the text itself if it is shorter, nothing if it is empty."""
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern % k), F.lit(1))
    # A search by look-ahead stops at each UTF-16 unit; the second half of a pair is no place.
    paired = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    runs = F.when(paired, find(r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))")).otherwise(find(r"(?s)(?=(.{%d}))"))
    return F.when(F.length(text) >= k, runs).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def _packed(text: Column, k: int, first: Column | int = 0) -> Column:
    """Hash and place of each k-mer, the first one's place being `first`; without nulls by its type, so that it is sorted as longs."""
    pack = lambda h, i: F.coalesce(F.shiftleft(h.cast("long"), _PLACE_BITS) + i + first, F.lit(0).cast("long"))
    runs = F.transform(_kmers(text, k), lambda x, i: pack(F.hash(x), i))
    # In ASCII a k-mer is k bytes, with the hash of the string; the bytes are bound by a lambda, so that they are made once.
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - k, F.lit(0)))
    cuts = F.get(F.transform(F.array(text.cast("binary")), lambda b: F.transform(places, lambda i: pack(F.hash(F.substring(b, i + 1, F.lit(k))), i))), 0)
    plain = (F.octet_length(text) == F.length(text)) & (text != "")
    return F.coalesce(F.when(plain, cuts).otherwise(runs), F.array_repeat(F.lit(0).cast("long"), 0))


def _rank(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def _numbers(again: Column) -> Column:
    """2, 3, ... for the entries of each k-mer in a sorted array that lacks first occurrences.

    Runs of one k-mer are found in a string of nine digits an entry, by one
    search for a name and its repetitions.
    """
    names = F.array_join(F.transform(again, lambda x: F.hex(_rank(x).bitwiseAND(F.lit(0xFFFFFFFF)) + (1 << 32))), "")
    runs = F.regexp_extract_all(names, F.lit(r"(.{9})(?:\1)*+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.sequence(F.lit(2), (F.length(r) / 9 + 1).cast("int"))))


def _same(x: Column, y: Column) -> Column:
    return F.shiftright(x.bitwiseXOR(y), _PLACE_BITS) == 0


def _near(df: DataFrame) -> Callable[[Column], Column]:
    return lambda x: x.bitwiseAND(F.lit((1 << _BIN_SHIFT) - 1)) < F.col("__near")


def _ranked(df: DataFrame, packed: str, n: Column) -> DataFrame:
    """df with what fingerprints of parts of column packed need, found in one pass over it.

    __s: it all, sorted, so that k-mers of one hash stand together by place.
    __w: of __s the entries whose k-mer occurs more than once. __n: of __s
    those near a bin's mark by their k-mer's hash, LIKELY of a bin among n;
    __near says how far that is.
    """
    bins, s = 1 << BINS_BITS, F.col("__s")
    share = F.least(F.lit(1.0), F.lit(float(bins * LIKELY)) / F.greatest(n, F.lit(1)))
    df = df.withColumn("__s", F.sort_array(packed)).withColumn("__near", (share * float(1 << _BIN_SHIFT)).cast("long")).drop(packed)
    # Neighbours of one hash, both of them; the few entries that come out twice are told apart by their places.
    pairs = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), s, lambda y, x: F.when(_same(x, y), F.array(F.coalesce(x, y), y)))
    return df.withColumns({"__w": F.array_distinct(F.flatten(F.array_compact(pairs))), "__n": F.filter(s, _near(df))})


def _sketch(df: DataFrame, out: str, own: Callable[[Column], Column] | None = None) -> DataFrame:
    """Column out: the entries of the fingerprint of the k-mers of _ranked() for which own holds.

    Each k-mer's number is how many of its like stand before it. A first
    occurrence keeps its k-mer's hash as rank, a later one gets another.
    Sorted by rank, with a mark where each bin begins, the least of a bin
    follow its mark. For that the ranks near the marks are enough; a text that
    has fewer than TUPLE of them in some bin is sorted whole.
    """
    s, bins, near = F.col("__s"), 1 << BINS_BITS, _near(df)
    marks = F.array(*[F.lit((b - bins // 2) << _BIN_SHIFT).cast("long") for b in range(bins)])
    mine = (lambda a: F.filter(a, own)) if own else (lambda a: F.col(a) if isinstance(a, str) else a)
    df = df.withColumns({"__v": mine("__w"), "__m": mine("__n")})
    v = F.col("__v")
    df = df.withColumn("__again", F.array_compact(F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), v, lambda y, x: F.when(_same(x, y), y)))).drop("__v")
    later = F.zip_with("__again", _numbers(F.col("__again")), lambda x, n: F.coalesce(F.shiftleft(F.hash(_rank(x), n).cast("long"), _PLACE_BITS) + _place(x), F.lit(0).cast("long")))
    df = df.withColumn("__later", later).drop("__again")

    def firsts(a: Column) -> Column:
        """Of a sorted array the first entry of each k-mer."""
        before = F.concat(F.array(F.coalesce(F.bitwise_not(F.get(a, 0)), F.lit(0))), a)
        return F.array_compact(F.zip_with(a, before, lambda x, y: F.when(~_same(x, y), x)))

    df = df.withColumn("__few", F.sort_array(F.concat(firsts(F.col("__m")), F.filter("__later", near), marks))).drop("__m")
    places = lambda a: F.array(*[F.array_position(a, F.lit((b - bins // 2) << _BIN_SHIFT).cast("long")).cast("int") for b in range(bins)])
    df = df.withColumn("__at", places("__few"))
    ends = F.concat(F.slice("__at", 2, bins - 1), F.array(F.size("__few") + 1))
    df = df.withColumn("__enough", (F.col("__near") >= 1 << _BIN_SHIFT) | F.forall(F.zip_with(ends, "__at", lambda y, x: y - x > TUPLE), lambda enough: enough))
    df = df.withColumn("__a", F.when(F.col("__enough"), F.col("__few")).otherwise(F.sort_array(F.concat(firsts(mine(s)), "__later", marks)))).drop("__later", "__few")
    df = df.withColumn("__at", F.when(F.col("__enough"), F.col("__at")).otherwise(places("__a"))).drop("__enough")
    a = F.col("__a")

    def entry(at: Column, b: Column) -> Column:
        """The bin and the hash of its k-mers in text order; null for an empty bin."""
        inside = lambda v: v.isNotNull() & ((b == bins - 1) | (v < F.shiftleft((b + 1 - bins // 2).cast("long"), _BIN_SHIFT)))
        x, y = F.get(a, at), F.get(a, at + 1)
        pair = F.when(~inside(y), F.hash(_rank(x))).when(_place(x) < _place(y), F.hash(_rank(x), _rank(y))).otherwise(F.hash(_rank(y), _rank(x)))
        digits = F.concat(F.lpad(F.hex(b), 2, "0"), F.lpad(F.hex(pair.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
        return F.when(inside(x), F.lower(digits))

    return df.withColumn(out, F.filter(F.transform("__at", entry), lambda e: e.isNotNull())).drop("__a", "__at")


def likeness(a: Column, b: Column) -> Column:
    """Bins in which two fingerprints' entries agree, of the bins that either has; 1 if neither has any."""
    bins = partial(F.transform, f=lambda e: F.substring(e, 1, 2))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with column fingerprint: entries of 2 (bin) and 8 (tuple) hexadecimal digits, joined by "-".

    Null and empty texts have the empty fingerprint; a text shorter than k is
    one k-mer. An input column of that name is replaced.
    """
    df = docs.drop("fingerprint").withColumn("__p", _packed(text_column(text), k))
    df = _sketch(_ranked(df, "__p", F.size("__p")), "fingerprint")
    return df.withColumn("fingerprint", F.array_join("fingerprint", "-")).drop(*_RANKED)


def _neighbours(docs: DataFrame) -> DataFrame:
    """key, doc_id, next_key, asks (how many characters the previous document wants of this one), before_key: one row per id and text, in a ring of ascending ids.

    Ids are dealt by range; each range is a window of its own, and the few
    ends of ranges are linked in a second step.
    """
    ids = docs.groupBy("key", "doc_id").agg(F.any_value("n").alias("n"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(ids.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).withColumn("range", F.spark_partition_id()).withColumn("place", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")))
    here = Window.partitionBy("range").orderBy("place")
    ends = ids.groupBy("range").agg(F.min_by("key", "place").alias("first_key"), F.max_by(F.struct("key", "n"), "place").alias("last"))
    ring = Window.orderBy("range")  # one row a range
    all_ = Window.partitionBy()
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first_key").over(ring), F.min_by("first_key", "range").over(all_)).alias("after"),
        F.coalesce(F.lag("last").over(ring), F.max_by("last", "range").over(all_)).alias("before"),
    )
    linked = ids.select("*", F.lead("key").over(here).alias("next"), F.lag(F.struct("key", "n")).over(here).alias("previous")).join(F.broadcast(ends), "range")
    before = F.coalesce("previous", "before")
    return linked.select("key", "doc_id", F.coalesce("next", "after").alias("next_key"), before["key"].alias("before_key"), F.floor(before["n"] / 4).cast("int").alias("asks"))


def compare_with_edits(docs: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of its code points replaced by as many of the next document's first ones.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is that of the next larger id,
    after the last the first; null ids come before all others, and rows of
    one id follow each other in the order of a hash of their texts. Rows that
    repeat both id and text count once in this order and get the same result.
    A quarter is rounded down; a next document that is shorter gives all it
    has. Null texts are empty; a text of any length lies in one row's arrays
    (8 bytes a character), one with few different k-mers is sorted whole. Of
    equal ranks the k-mer that stands first in the text counts. An empty table
    gives an empty result; further columns of docs are ignored, whatever their
    names. Rows meet by a 64-bit hash of id and text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    links = cut(_neighbours(keyed.select("key", "doc_id", F.length("text").alias("n"))))
    texts = keyed.select("key", "text").join(links, "key")  # twice the same exchange, which Spark makes once
    given = texts.groupBy(F.col("before_key").alias("key")).agg(F.any_value(F.substring(F.col("text"), F.lit(1), F.col("asks"))).alias("given"))
    both = texts.select("key", "next_key", "doc_id", "text").join(given, "key").withColumn("n", F.length("text"))

    stays = F.col("n") - F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), stays), F.col("given"))
    shared = F.greatest(stays - k + 1, F.lit(0))  # k-mers that lie in what stays
    df = both.withColumns({"edited": edited, "shared": shared, "p": _packed(F.col("text"), k)}).drop("given")
    df = df.withColumns({"edited_sha256": F.sha2("edited", 256), "tail": F.substring(F.col("edited"), F.col("shared") + 1, F.length("edited"))}).drop("edited", "text")
    own = F.when((F.length("tail") >= k) | (F.col("shared") == 0), _packed(F.col("tail"), k, F.col("shared") + _ONLY_EDITED)).otherwise(F.slice("p", 1, 0))
    df = df.withColumns({"p": F.concat("p", own), "kmers": F.size("p")}).drop("tail")
    # What the text and its edited text share is hashed, sorted and searched once.
    df = _ranked(df, "p", F.col("kmers"))
    df = _sketch(df, "fingerprint", lambda x: _place(x) < _ONLY_EDITED)
    df = _sketch(df, "edited_fingerprint", lambda x: (_place(x) < F.col("shared")) | (_place(x) >= _ONLY_EDITED))
    done = stored(df.select("key", "next_key", "doc_id", "n", "edited_sha256", "fingerprint", "edited_fingerprint"))

    after = done.groupBy(F.col("key").alias("next_key")).agg(F.any_value("fingerprint").alias("next"))
    out = done.join(after, "next_key")
    name = lambda c: F.array_join(c, "-").alias(c)
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        name("fingerprint"),
        name("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
