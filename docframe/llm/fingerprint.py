"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's letters are its words: runs of up to WORD characters that aren't ASCII white space. In longer runs, as
unspaced scripts have them, a letter begins at every character: the PIECE characters from there on. So a letter
depends on nothing but itself and its run's ends. Each K consecutive letters make a k-mer, whose K - 1 pairs of
neighbours are its inner substrings. A k-mer is chosen as an anchor if the least pair hash stands at either edge: that
depends on nothing but its letters, so equal stretches of two texts choose equal anchors.

The fingerprint is the SIZE least hashes of chosen k-mers, each with the place where it is first chosen. Two
fingerprints are matched by places: an anchor that both have counts if it follows the one before it in both texts.
The likeness is the share of those among the SIZE least of both, an estimate of the resemblance of the sets of
anchors less what stands in another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import doc_id, keyed
from .token_output import bucket_of, constant, id_bounds

WORD, PIECE, K, SIZE = 32, 4, 5, 64
#: Bits of a place, of which an anchor's hash leaves that many free; later places count as the last one.
AT = 23
_LAST = (1 << AT) - 1
#: Ranges of ids at most, and ranges for each shuffle partition.
BUCKETS, SHARE = 1 << 15, 16


def _letters(text: Column) -> Column:
    """Hashes of the letters."""
    word = rf"(?<!\S)\S{{1,{WORD}}}+(?!\S)"
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?=({word}|\S{{1,{PIECE}}}))(?:{word}|\S)"), F.lit(1)), lambda x: F.xxhash64(x))


def _anchor(hashed: Column, at: Column) -> Column:
    """40 bits of the hash, then the place."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 24), AT).bitwiseOR(F.least(at, F.lit(_LAST)).cast("long"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the column out: the chosen k-mers' hashes with their first letters' numbers.

    A text without a chosen k-mer has one anchor for all of it, one without letters has none.
    """
    one, two = f"{out}_one", f"{out}_two"
    df = df.withColumn(one, _letters(F.col(text)))
    # neighbours pairwise; the last element pairs with nothing and is null
    df = df.withColumn(two, F.zip_with(F.col(one), F.slice(F.col(one), 2, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    pair = lambda i, j: F.get(F.col(two), i + F.lit(j))
    last = K - 2

    def chosen(first: Column, i: Column) -> Column:
        least = F.least(*(pair(i, j) for j in range(1, last + 1)))  # of all but the first
        whole = (i + F.lit(last + 1)) < F.size(one)
        return F.when(whole & ((first <= least) | ((least == pair(i, last)) & (least <= first))), _anchor(F.xxhash64(first, *(pair(i, j) for j in range(2, last + 1))), i))

    df = df.withColumn(out, F.filter(F.transform(F.col(two), chosen), lambda a: a.isNotNull()))
    own = _anchor(F.xxhash64(F.array_join(F.transform(F.col(one), lambda h: h.cast("string")), ",")), F.lit(0))
    return df.withColumn(out, F.when((F.size(out) > 0) | (F.size(one) == 0), F.col(out)).otherwise(F.array(own))).drop(one, two)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the column out: the SIZE least anchors with different hashes, ascending, each at its first place."""
    anchors = f"{out}_anchors"
    df = with_anchors(df, text, anchors).withColumn(anchors, F.sort_array(anchors))
    new = lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(F.col(anchors), i - 1)))
    return df.withColumn(out, F.slice(F.filter(F.col(anchors), new), 1, SIZE)).drop(anchors)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, AT)


def _at(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(_LAST))


def printed(sketch: Column) -> Column:
    """Sixteen hex digits for each anchor."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the column out: anchors in one order in both sketches as a share of the least SIZE of both; 1 for two
    empty ones."""
    hashes = lambda c: F.transform(F.col(c), _hash)
    places = lambda c: F.map_from_arrays(hashes(c), F.transform(F.col(c), _at))
    df = df.withColumn("_least", F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, SIZE))
    df = df.withColumn("_pa", places(a)).withColumn("_pb", places(b))
    df = df.withColumn("_common", F.filter(F.col("_least"), lambda h: F.map_contains_key("_pa", h) & F.map_contains_key("_pb", h)))

    def ordered(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
        both = lambda h: F.shiftleft(F.element_at(x, h), AT).bitwiseOR(F.element_at(y, h))
        df = df.withColumn("_order", F.sort_array(F.transform(F.col("_common"), both)))
        return df.withColumn(out, F.size(F.filter(F.col("_order"), lambda p, i: (i == 0) | (_at(p) > _at(F.get(F.col("_order"), i - 1))))))

    df = ordered(ordered(df, "_pa", "_pb", "_ab"), "_pb", "_pa", "_ba")
    share = F.when(F.size("_least") == 0, F.lit(1.0)).otherwise(F.least("_ab", "_ba") / F.size("_least"))
    return df.withColumn(out, share).drop("_least", "_pa", "_pb", "_common", "_order", "_ab", "_ba")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the struct next: columns of the following row by descending (id, th); after the last comes the first.

    Rows go to ranges of ids. The greatest id of a range is an id that occurs, so its rows are also sent to the
    range above, where they follow its least row; the greatest of all is sent to the lowest range.
    """
    spark = docs.sparkSession
    # many to a task, so that tasks are alike whichever buckets they get
    buckets = min(BUCKETS, SHARE * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = id_bounds(docs.select("id"), buckets)
    top = docs.agg(F.max("id")).first()[0]
    bucket = bucket_of(F.col("id"), bounds)
    place = lambda b, turn: F.struct(b.cast("int").alias("bucket"), F.lit(turn).alias("turn"))
    places = [F.array(place(bucket, 0))]
    none = F.expr("cast(array() as array<struct<bucket: int, turn: int>>)")
    edge = F.coalesce(F.get(constant(bounds), bucket) == F.col("id"), F.lit(False))
    places.append(F.when(edge, F.array(place(bucket + 1, 1))).otherwise(none))
    places.append(F.when(F.col("id") == F.lit(top), F.array(place(F.lit(0), 2))).otherwise(none))
    rows = docs.withColumn("place", F.explode(F.concat(*places))).select("*", "place.bucket", "place.turn").drop("place")
    # a row sent along has a smaller id than all of its range, but for the greatest, which comes last
    order = Window.partitionBy("bucket").orderBy((F.col("turn") == 2).cast("int"), F.desc("id"), F.desc("th"))
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return rows.filter("turn = 0").drop("bucket", "turn")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    Takes doc_id and text (null: empty). The edited text has its last third replaced by the beginning of the
    next document by descending doc_id; after the last comes the first, so a single document is its own next.
    Rows with equal ids follow each other by a hash of the text, repeated rows one behind the other; a null doc_id comes
    last and stays null. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (empty for texts without
    letters), near_edited and near_next: likeness to the edited text's and to the next document's fingerprint. Very
    long texts are read whole; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = keyed(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    rows = with_next(with_sketch(rows, "text", "sketch"), ["text", "sketch"])
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    )
    rows = with_sketch(rows, "edited", "changed").withColumn("following", F.col("next.sketch"))
    rows = likeness(likeness(rows, "sketch", "changed", "near_edited"), "sketch", "following", "near_next")
    return rows.select(
        doc_id(),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
