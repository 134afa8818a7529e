"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Three base patterns are always reported.  Beside them a wide pattern proposes long mixed tokens.  Every candidate's value is
hashed, and the hashes are aggregated over the corpus by distinct repository and owner: what many owners have in
common is a copied example, what only one or two owners hold looks like a live credential.  Every reported span is told apart so.
Proposed tokens that overlap no base span are added, as kind ``live``, when they are owner-specific; examples are left out.

A proposed token must look drawn at random: among its letters and digits, the kind of character (capital, small, digit) must change
at ``CHANGES`` of the places or more, in runs of hexadecimal digits at half as many.  Names, paths and long words change at fewer.

The owner of a document is what precedes the first ``/`` of its source, the repository is the whole source.  Only hashes
and positions are shuffled.  Owners are counted in two steps, distinct (hash, repository) first, so that a value held by a
third of all rows is combined before it is shuffled.

Defined cases: a null text is an empty text; a null source counts as one owner with an empty name; repeated rows are
scanned as often as they come; a null id is passed through; no spans give empty strings (and the digest of one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, numbered, table

#: The base patterns, their kinds in order, and the least length of what they hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: The proposed kinds: a run of 20 or more token characters with a digit, an upper-case and a lower-case letter; the same of
#: upper-case hexadecimal digits with a letter, which HEX leaves out.
TOKEN = (
    r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
    r"|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{20,}(?![A-Za-z0-9+/_=-]))"
)
KINDS = ("assign", "access", "hex", "live")
PATTERNS = ((ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16), (TOKEN, 0, 20))
CHANGES = 0.4
MAX_OWNERS = 2
MAX_REPOSITORIES = 3
#: A value of so many spans is hot, in a corpus of many spans one of 1 / SPLIT of them.
HOT, SPLIT = 1024, 8192


def matches(text: Column, pattern: str, group: int) -> tuple[Column, Column, Column]:
    """Whole matches, their values, and the lengths of what stands between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return whole, value, F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))


def looks_drawn(value: Column) -> Column:
    """Whether the kind of character changes often enough."""
    bare = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    changes = F.regexp_count(bare, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"))
    share = F.when(bare.rlike("^[0-9A-F]+$"), CHANGES / 2).otherwise(CHANGES)
    return changes >= share * (F.char_length(bare) - 1)


def match_struct(kind: int, least: int):
    """Lambda for one match of a kind whose values need ``least`` characters."""

    def one(x: Column, i: Column) -> Column:
        long = F.char_length(x["v"]) >= least
        ok = long & looks_drawn(x["v"]) if KINDS[kind] == "live" else long
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["g"].alias("gap"), F.char_length(x["w"]).alias("size"), ok.alias("ok"), x["v"].alias("value"))

    return one


def find(docs: DataFrame, number: str | None = None) -> DataFrame:
    """``rid`` (the column ``number`` of ``docs`` if it has one), ``doc_id``, ``source`` and ``m``, the matches of every kind as (kind, pos,
    gap, size, value); one scan of the texts."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rid = F.col(number) if number else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k, (pattern, _, _) in enumerate(PATTERNS):
        rows = rows.withColumn(f"m{k}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    lists = []
    for k, (pattern, group, least) in enumerate(PATTERNS):
        _, value, gaps = matches(F.col("text"), pattern, group)
        zipped = F.arrays_zip(F.col(f"m{k}").alias("w"), value.alias("v"), F.slice(gaps, 1, F.size(f"m{k}")).alias("g"))
        lists.append(F.when(F.size(f"m{k}") > 0, F.transform(zipped, match_struct(k, least))))
    empty = F.array().cast("array<struct<kind:int,pos:int,gap:int,size:int,ok:boolean,value:string>>")
    return rows.select("rid", "doc_id", "source", F.concat(*[F.coalesce(x, empty) for x in lists]).alias("m"))


def spans(found: DataFrame) -> DataFrame:
    """``rid``, ``source``, ``kind``, ``start``, ``end``, ``h`` (hash of the value) of all matches that are long enough."""
    each = found.filter(F.size("m") > 0).select("rid", "source", F.explode("m").alias("x")).select("rid", "source", "x.*")
    order = Window.partitionBy("rid", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return each.withColumn("end", end.cast("long")).filter("ok").select("rid", "source", "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.xxhash64("value").alias("h"))


def ownership(all_spans: DataFrame) -> DataFrame:
    """``h``, ``live`` (whether the value is held by few owners and few repositories), ``owners`` and ``n`` (spans)."""
    by_repository = all_spans.groupBy("h", "source").agg(F.count("*").alias("n"))
    owner = F.split_part("source", F.lit("/"), F.lit(1))
    by_owner = by_repository.groupBy("h", owner.alias("owner")).agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    totals = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    live = (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES)
    return totals.select("h", live.alias("live"), F.col("owners").cast("long").alias("owners"), "n")


def judged_by_owners(every: DataFrame) -> DataFrame:
    """Spans with ``live`` and ``owners`` of their values.  Values of many spans (at most ``SPLIT`` of them) are broadcast, so that a
    value held by a third of all rows stays where it is; the others are shuffled."""
    held = materialize(ownership(every), "owners")
    most = F.greatest(F.lit(HOT), F.floor(F.sum("n") / SPLIT))
    hot = held.agg(most).first()[0] or HOT
    few = F.broadcast(held.filter(F.col("n") > hot).drop("n"))
    rest = every.join(few.select("h"), "h", "left_anti").join(held.filter(F.col("n") <= hot).drop("n"), "h")
    return every.join(few, "h").unionByName(rest)


def decide(found: DataFrame) -> DataFrame:
    """``rid``, ``kept`` (reported spans as (start, kind, end, live), in order), ``n_live`` and ``n_example`` of rows with candidates."""
    every = materialize(spans(found), "spans")
    judged = judged_by_owners(every)
    base = F.col("kind") < 3
    order = Window.partitionBy("rid").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    shown = judged.withColumn("keep", base | (F.col("live") & free)).withColumn("counted", base | free)
    span = F.struct("start", "kind", "end", "live")
    return shown.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(F.col("keep"), span))).alias("kept"),
        F.count(F.when(F.col("counted") & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("counted") & ~F.col("live"), 1)).alias("n_example"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """Columns of the contract, then ``owned``, live or example for each span, and ``n_live`` and ``n_example``, which count examples
    among the proposed tokens too."""
    found = materialize(find(docs), "matches")
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])
    out = found.select("rid", "doc_id").join(decide(found), "rid", "left")
    kept = F.coalesce("kept", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>"))
    count = lambda k: F.size(F.filter(kept, lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans_: F.array_join(F.transform(spans_, named), ",")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter(kept, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(kept).alias("spans"),
        F.array_join(F.transform(kept, lambda s: F.when(s["live"], "live").otherwise("example")), ",").alias("owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``, and ``n_chars`` to match; all rows stay."""
    rid, spans_ = free_name(docs, "rid"), free_name(docs, "kept")
    numbers = numbered(docs, "numbered", rid)
    found = materialize(find(numbers, number=rid), "matches")
    kept = decide(found).filter(F.size("kept") > 0).select(F.col("rid").alias(rid), F.col("kept").alias(spans_))
    rows = numbers.join(kept, rid, "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def fold(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.char_length(text)))
    masked = F.when(F.col(spans_).isNotNull(), F.aggregate(spans_, start, fold, tail)).otherwise(text)
    rows = rows.withColumn("text", masked)
    n = F.char_length("text").cast("long")
    return rows.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
