"""Canonical exact digests of documents, in DataFrame functions only.

The canonical form of a text is its compatibility composition, case-folded and composed again, with every run of white space
as one space and none at the ends.  Its digest is two chained XXH64 values (128 bits).  Within a bucket of equal digests the
canonical bytes are compared by grouping on them; buckets that hold only one row are left out of that comparison by a
bitmap of fixed size over the digests that occur more than once.  A bucket of several byte strings gets the SHA-256 of the
canonical form appended to its fingerprints, so equal fingerprints always mean equal canonical bytes.

The edited text of a document needs the next document in the order of ids: rows go to ranges of ids, whose bounds come
from approximate quantiles, and the first rows of a range are also sent to the range before it.  Texts are shuffled once.

Defined cases: a null text is an empty text; a null id sorts before all others; rows with the same id follow each other in
the order of their text's hash; the only row of a table is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BITMAP_BITS, MOST_BITS = 1 << 25, 1 << 29  # 4 MB to 64 MB, by the number of repeated digests
RANGES_PER_PARTITION = 4
LOWEST = -(1 << 63)


def canonical(text: Column) -> Column:
    """Normalised, case-folded, white-space-folded form of a text column that has no nulls."""
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.btrim(F.regexp_replace(folded, r"(?U)\s+", " "), F.lit(" "))


def wide_hash(value: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two XXH64 values of a column; fewer ``bits`` are kept only to test the handling of collisions."""
    a, b = F.xxhash64(value), F.xxhash64(F.lit(1), value)
    return (a, b) if bits == 64 else (F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("long"))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range of ascending ``bounds`` that ``key`` is in, by binary search."""
    at = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 16 else F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = max(1, len(bounds).bit_length())

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"] + 1) / 2).cast("int")
        up = F.element_at(at, mid + 1) <= key
        return F.struct(F.when(up, mid).otherwise(span["lo"]).alias("lo"), F.when(up, span["hi"]).otherwise(F.greatest(mid - 1, span["lo"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text`` of every document, in the order of ids and round at the end."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    shares = [k / ranges for k in range(ranges)]
    seen = docs.agg(F.min(key), F.percentile_approx(key, shares, 10000)).first()
    bounds = sorted({seen[0], *seen[1]}) if seen[0] is not None else [0]
    n = len(bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("range", range_of(key, bounds))
    if n <= 16:
        first = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("range") + 1)
    else:
        first = F.element_at(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.col("range") + 1)
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("to"), F.lit(True).alias("guest"))
    sent = rows.select("doc_id", "text", F.explode(F.when(key == first, F.array(own, before)).otherwise(F.array(own))).alias("s"))
    sent = sent.select("doc_id", "text", F.col("s.to").alias("to"), F.col("s.guest").alias("guest"), F.xxhash64("text").alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("to").orderBy("guest", F.asc_nulls_first("doc_id"), "tie")  # every later branch needs just these columns, so the shuffle is made once
    return sent.repartition(parts, "to").withColumn("next_text", F.lead("text").over(order)).filter(~F.col("guest")).select("doc_id", "text", "next_text")


def bitmap_bits(repeated: int) -> int:
    """Bits for so many digests: sixteen each, between fixed bounds."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (16 * repeated).bit_length()))


def repeated_bitmap(many: DataFrame, bits: int) -> DataFrame:
    """Bitmaps over ``bits`` positions, with a bit for every digest ``h1``, ``h2`` of ``many``."""
    at = F.pmod("h1", F.lit(bits)) + 1
    return many.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def may_repeat(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest has its bit set; the bitmap has at most MOST_BITS bits, so it is sent to all tasks."""
    at = F.pmod("h1", F.lit(bits)) + 1
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at)).join(F.broadcast(bitmap), "bucket")
    set_ = "(shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1) = 1"
    return joined.filter(set_).drop("bucket", "bit", "bits")


def exact_digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document with the digests of its text and of its edited text; columns as in the contract.

    Canonical forms are made once and stored with their digests; only those of repeated digests are read again."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(docs, RANGES_PER_PARTITION * parts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    full = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(edited).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon"))
    (h1, h2), (e1, e2) = wide_hash(F.col("canon"), bits), wide_hash(F.col("edited_canon"), bits)
    near = lambda other: (F.col("canon") == F.col(other)).cast("double")
    stored = materialize(
        full.select(
            "doc_id", "n_chars", "edited_sha256", h1.alias("h1"), h2.alias("h2"), e1.alias("e1"), e2.alias("e2"), F.sha2("canon", 256).alias("long1"), F.sha2("edited_canon", 256).alias("long2"),
            near("edited_canon").alias("near_edited"), near("next_canon").alias("near_next"), "canon", "edited_canon",
        ),
        "canonical",
    )

    own, other = F.struct("h1", "h2", "canon"), F.struct(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("edited_canon").alias("canon"))
    digests = stored.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("e1").alias("h1"), F.col("e2").alias("h2")))).alias("x")).select("x.*")
    many = materialize(digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated")
    size = bitmap_bits(many.count())
    both = stored.select(F.explode(F.array(own, other)).alias("x")).select("x.*")
    compared = may_repeat(both, repeated_bitmap(many, size), size).groupBy("h1", "h2", "canon").agg(F.lit(1).alias("one"))
    mixed = compared.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2", F.lit(True).alias("mixed"))

    rows = stored.drop("canon", "edited_canon")
    rows = rows.join(mixed, ["h1", "h2"], "left").join(mixed.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("mixed").alias("edited_mixed")), ["e1", "e2"], "left")
    name = lambda a, b, mix, long: F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"), F.when(mix, F.concat(F.lit("-"), long)).otherwise(F.lit("")))
    return rows.select("doc_id", "n_chars", "edited_sha256", name("h1", "h2", F.col("mixed"), F.col("long1")).alias("fingerprint"), name("e1", "e2", F.col("edited_mixed"), F.col("long2")).alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digests(table(spark, sf_dir, "documents"))
