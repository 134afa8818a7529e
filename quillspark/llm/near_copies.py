"""SimHash near-dedup for the pipeline: two texts belong together when the Jaccard similarity of their sets of five-word shingles is
at least ``SHARE[0] / SHARE[1]``, and a class is a connected component of such pairs.

SimHash proposes the pairs, by multi-index hashing.  A text's sketch of ``SEGMENTS`` segments of 32 bits is the majority of its
word pairs' bits; every segment is a table, the text enters it at its own value and probes the small Hamming ball of values that
differ in some of the segment's ``FLIPS`` least certain bits.  Texts that meet in a cell, and whose sizes allow the similarity, form a
group, in which the shingle sets themselves are compared, so a pair below the similarity is never linked.  A pair at the
similarity differs in about 9 % of the bits and meets in more than half of the segments; that it meets in none has a chance of
about one in a thousand (a test measures it).

Texts that share a cell by their own values are compared first; what that connects is one class, and cells that then hold a single
class are left out of the second round, that of the probes.  So a large group of copies is not met again in every cell around it.

Probes of cells that nothing has entered are left out before the shuffle; a bitmap of fixed size knows those cells, and its false
marks cost time, never a result.  A group is never turned into all its pairs (see :func:`links_of_group`).

Crowded cells, and groups of more than ``BLOCK`` members, are not compared cell by cell.  In the first round, which need not be complete,
such a group is cut into blocks that share a few members.  In the second, the members of all of them are one set of rows, each
there once, in which all similar pairs are found; so cells that hold nothing else are left out.  They go to shelves: similar sets
share one of their rarest shingles (see :func:`prefix`).  Shelves are first compared in blocks that share a few members, which
makes one class of most copies.  Then, in shelves that still hold several classes, what is not in the largest class meets that class
and each other, in pairs of blocks; the largest class is not met with itself.  So a shelf gives at most twice its rows while
at most ``BLOCK`` of them are outside its largest class; beyond, its rows grow with the square of the number outside.

Defined cases: a null text is an empty text; fewer words than a shingle has give one shingle of all words; all texts
without words are copies of each other; rows of equal sets are one set.  Shingles and sets are named by 64-bit hashes.  Columns of
any name may come along, none is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import arrow_schema, free_name, materialize, release
from .components import components
from .simhash import SEED, bit_counts, more_bits, words_of
from .suffix_dedup import _bitmap, _marked

SHINGLE = 5
SHARE = (4, 5)
PAIR = 2
SEGMENTS, WIDTH, FLIPS = 8, 32, 6
BLOCK, SHARED = 512, 16
COUNTERS, CHUNK = 1 << 18, 4096
HOT, SPLIT = 128, 8192
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_WORDS = _WordHashes()


def shingles(words: list[str], size: int) -> np.ndarray:
    """The distinct shingles of some words, as sorted hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h += w[k : len(w) - size + 1 + k] * _FACTORS[k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as signed numbers in one order for all."""
    return np.sort(shingles(words_of(text), SHINGLE).view(np.int64))


def sketch(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the segments, and the bits of each that are least certain, as one-bit masks."""
    pairs, counts = shingles(words, PAIR), np.zeros(SEGMENTS * WIDTH, dtype=np.int64)
    for at in range(0, len(pairs), 20_000):
        counts += bit_counts(more_bits(pairs[at : at + 20_000], SEGMENTS * WIDTH // 64))
    value = np.packbits(counts * 2 > len(pairs), bitorder="little").view("<u4").astype(np.int64)
    doubt = np.argsort(np.abs(counts * 2 - len(pairs)).reshape(SEGMENTS, WIDTH), axis=1, kind="stable")[:, :FLIPS]
    return value, np.int64(1) << doubt


_SUBSETS = ((np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)[None, :]) & 1).astype(np.int64)


def cells_of(value: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Cells of a sketch, one row a segment: the entry first, then the ball around it."""
    ball = value[:, None] ^ (masks @ _SUBSETS.T)
    return ball | (np.arange(SEGMENTS, dtype=np.int64) << WIDTH)[:, None]


def alike(common: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` members with ``common`` ones are similar enough."""
    return (SHARE[0] + SHARE[1]) * common >= SHARE[0] * (n + m)


def prefix(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, rarest first: two similar sets share one of them.

    Of the members that they share, at least ``SHARE[0] / SHARE[1]`` of either set, the first in the common order has all others
    behind it in both.  The order is by counter, then value; it decides how many sets meet, not whether similar ones do.
    """
    rare = np.lexsort((members, counts[members & (COUNTERS - 1)]))
    return members[rare[: len(members) + 1 + -SHARE[0] * len(members) // SHARE[1]]]


def links_of_group(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (member, member) that connect all pairs of similar sets; each link reaches a new member."""
    sizes = np.array([len(s) for s in sets])
    todo = sizes > 0
    if todo.sum() < 2:
        return []
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    filled = np.flatnonzero(todo)
    flags = np.zeros(len(names), dtype=bool)
    links: list[tuple[int, int]] = []
    for first in filled.tolist():
        grown = [first] if todo[first] else []
        todo[first] = False
        while grown and todo.any():
            x = grown.pop()
            own = at[starts[x] : starts[x + 1]]
            flags[own] = True
            common = np.zeros(len(sets), dtype=np.int64)
            common[filled] = np.add.reduceat(flags[at].astype(np.int64), starts[filled])
            flags[own] = False
            hit = np.flatnonzero(todo & alike(common, sizes, sizes[x])).tolist()
            links += [(x, y) for y in hit]
            grown += hit
            todo[hit] = False
    return links


def runs_of_cell(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Distinct ids of a cell, cut where the sizes leave no similar pair across the cut."""
    ids, k = np.unique(ids, return_index=True)
    sizes = sizes[k]
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    cut = np.flatnonzero(SHARE[1] * n[:-1] < SHARE[0] * n[1:]) + 1
    return [ids[r] for r in np.split(order, cut) if len(r) > 1]


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches again, cut so that no value of the first ``keys`` columns is in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1].as_py() for k in range(keys)]
        other = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            other |= batch.column(k).to_numpy() != last[k]
        before = np.flatnonzero(other)
        if len(before):
            yield pa.Table.from_batches([*held, batch.slice(0, int(before[-1]) + 1)])
            held = [batch.slice(int(before[-1]) + 1)]
        elif held and any(held[-1].column(k)[-1].as_py() != last[k] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(part: pa.Table, keys: int) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of every value of the first ``keys`` columns that has several rows."""
    new = np.zeros(part.num_rows - 1, dtype=bool)
    for k in range(keys):
        x = part.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    first = np.flatnonzero(np.append(True, new))
    end = np.append(first[1:], part.num_rows)
    many = end - first > 1
    return zip(first[many].tolist(), end[many].tolist(), strict=True)


def numbered_sets(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` as a table of its own with three more columns, whose names are returned: the number of the row, the name of its shingle
    set, and its sketch (size of the set, segment values, masks)."""
    rid, name, drawn = free_name(docs, "rid"), free_name(docs, "id"), free_name(docs, "sketch")
    names, place = [rid, name, drawn, *docs.columns], docs.columns.index("text") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sketches = [], []
            for t in batch.column(place):
                words = words_of(t.as_py())
                own = np.sort(shingles(words, SHINGLE).view(np.int64))
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                value, masks = sketch(words)
                sketches.append(np.concatenate([[len(own)], value, masks.ravel()]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(sketches, type=pa.binary()), *batch.columns[1:]], names)

    rows = docs.withColumn("text", F.col("text").cast("string"))
    schema = StructType([StructField(rid, LongType()), StructField(name, LongType()), StructField(drawn, BinaryType()), *rows.schema.fields])
    return materialize(rows.select(F.monotonically_increasing_id().alias(rid), *docs.columns).mapInArrow(run, schema), "numbered"), rid, name, drawn


def sized(groups: DataFrame, large: bool) -> DataFrame:
    """Members of the groups of more than ``BLOCK``, or of the others."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    return groups.join(sizes.filter(F.col("m") > BLOCK).select("grp"), "grp", "left_semi" if large else "left_anti")


def blocks_alone(groups: DataFrame) -> DataFrame:
    """Every member in one block of its group, about ``SHARED`` of them in all blocks."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("c"))
    own, shared = F.pmod(F.xxhash64("id"), F.col("c")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("m")) < SHARED
    return groups.join(sizes, "grp").select("grp", F.explode(F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).otherwise(F.array(own))).alias("block"), "id")


def blocks_across(groups: DataFrame) -> DataFrame:
    """Members of different classes of a group in a block in common, those of its largest class only with others."""
    by_class = groups.groupBy("grp", "cls").agg(F.count("*").alias("n"))
    count = lambda x: F.ceil(x / F.lit(BLOCK))
    sizes = by_class.groupBy("grp").agg(F.max_by("cls", F.struct("n", "cls")).alias("top"), F.max("n").alias("t"), F.sum("n").alias("m")).filter("m > t")
    whole = F.col("m") <= BLOCK
    sizes = sizes.select("grp", "top", F.when(whole, 0).otherwise(count(F.col("t"))).alias("ct"), F.when(whole, 1).otherwise(count(F.col("m") - F.col("t"))).alias("cr"))
    h, ct, cr = F.xxhash64("id"), F.col("ct"), F.col("cr")
    pair = lambda i, j: F.least(i, j) * (ct + cr) + F.greatest(i, j)
    at_top, at_rest = F.pmod(h, F.greatest(ct, F.lit(1))), ct + F.pmod(h, cr)
    # blocks below ct are of the largest class; each other block meets those, and with them its own members
    of_top = F.transform(F.sequence(ct, ct + cr - 1), lambda j: pair(at_top, j))
    of_rest = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), ct + cr - 1), lambda j: F.when(j != at_rest, pair(at_rest, j))), lambda x: x.isNotNull())
    block = F.when(ct == 0, F.array(F.lit(0).cast("long"))).when(F.col("cls") == F.col("top"), of_top).otherwise(of_rest)
    return groups.join(sizes, "grp").select("grp", F.explode(block).alias("block"), "id")


def in_mixed(shelves: DataFrame) -> DataFrame:
    """Rows of shelves of several classes that have members enough left to be similar to a set as small as the shelf holds."""
    kinds = shelves.groupBy("grp").agg(F.min("n").alias("least"), F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    smallest = F.greatest(F.col("least"), F.ceil(SHARE[0] * F.col("n") / F.lit(SHARE[1])))
    return shelves.join(kinds, "grp").filter((SHARE[0] + SHARE[1]) * F.col("rest") >= SHARE[0] * (F.col("n") + smallest)).drop("least", "low", "high")


def similar_links(rows: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the ``id`` of ``rows`` (``id``, ``text``, ``sketch``) that connect all proposed pairs of similar sets."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sets_of(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[int, np.ndarray]]:
        """Name and shingles of the sets of a task, a repeated one mostly once."""
        done: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k in range(len(ids)) if wanted is None else np.flatnonzero(wanted(ids)).tolist():
                if int(ids[k]) not in done:
                    if len(done) > 1_000_000:
                        done.clear()
                    done.add(int(ids[k]))
                    yield int(ids[k]), shingle_set(batch.column(1)[k].as_py())

    def longs(rows_: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for row in rows_:
            held.append(row)
            size += len(row[0])
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    sketches = materialize(rows.groupBy("id").agg(F.min("sketch").alias("sketch")), "sketches")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, sizes, classes and cells (rows, segments, ball) of some sketches of texts with words."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").astype(np.int64).reshape(batch.num_rows, -1)
                some = raw[:, 0] > 0
                ids, cls, raw = batch.column(0).to_numpy()[some], batch.column(2).to_numpy()[some], raw[some]
                masks = raw[:, SEGMENTS + 1 :].reshape(len(raw), SEGMENTS, FLIPS)
                yield ids, raw[:, 0], cls, (raw[:, 1 : SEGMENTS + 1, None] ^ (masks @ _SUBSETS.T)) | (np.arange(SEGMENTS, dtype=np.int64) << WIDTH)[None, :, None]

    def mixed_bits(cell: np.ndarray) -> np.ndarray:
        h = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, cls, cell in read(batches):
            own = cell[:, :, 0]
            each = [np.repeat(x, own.shape[1]) for x in (ids, n, cls)]
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), *map(pa.array, each), pa.array(np.ones(own.size, dtype=bool)), pa.array(mixed_bits(own.ravel()))], ["cell", "id", "n", "cls", "entry", "h"])

    cell_kinds = "cell long, id long, n long, cls long, entry boolean"
    first = sketches.select("id", "sketch", F.col("id").alias("cls"))
    own_cells = materialize(first.mapInArrow(entries, f"{cell_kinds}, h long"), "entries")
    entered = spark.sparkContext.broadcast(_bitmap(own_cells.select("h")))

    def rows_of_cells(rows_: DataFrame, hot: DataFrame | None = None) -> DataFrame:
        """Entries and probes, of cells that are not ``hot``; ``large``: the text is in a hot cell of several classes."""
        left_out, mixed = cells_in(hot), cells_in(hot, True)

        def enter_and_probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, n, cls, cell in read(batches):
                wanted = _marked(entered.value, mixed_bits(cell.ravel())).reshape(cell.shape)
                wanted[:, :, 0] = True
                if len(left_out.value):
                    wanted &= ~np.isin(cell, left_out.value)
                large = np.isin(cell, mixed.value).any(axis=(1, 2)) if len(mixed.value) else np.zeros(len(ids), dtype=bool)
                row, _, ball = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(cell[wanted]), *(pa.array(x[row]) for x in (ids, n, cls)), pa.array(ball == 0), pa.array(large[row])], ["cell", "id", "n", "cls", "entry", "large"])

        return rows_.mapInArrow(enter_and_probe, f"{cell_kinds}, large boolean")

    def cells_in(hot: DataFrame | None, only_mixed: bool = False):
        return spark.sparkContext.broadcast(np.array([r.cell for r in hot.collect() if r.mixed or not only_mixed] if hot else [], dtype=np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[np.ndarray]]:
            done: set[bytes] = set()
            for part in whole_keys(batches, 1):
                ids, sizes, cls = (part.column(k).to_numpy() for k in (1, 2, 3))
                entry, large = (part.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
                for a, b in bounds(part, 1):
                    if not entry[a:b].any() or (cls[a:b] == cls[a]).all() or large[a:b].all():
                        continue  # a false mark, a single class, or compared elsewhere
                    for run in runs_of_cell(ids[a:b], sizes[a:b]):
                        run = np.sort(run)
                        name = xxhash.xxh3_128_digest(run.tobytes())
                        if name not in done:
                            if len(done) > 200_000:
                                done.clear()
                            done.add(name)
                            yield [np.full(len(run), run[0]), run]

        yield from longs(groups(), ["grp", "id"])

    def crowded(cells: DataFrame) -> DataFrame:
        """The largest entered cells of more than HOT members, at most SPLIT, and whether they are of several classes."""
        counted = cells.groupBy("cell").agg(F.count("*").alias("m"), F.max("entry").alias("entry"), F.min("cls").alias("low"), F.max("cls").alias("high"))
        many = counted.filter((F.col("m") > HOT) & F.col("entry")).orderBy(F.desc("m"), "cell").limit(SPLIT)
        return materialize(many.select("cell", (F.col("low") < F.col("high")).alias("mixed")), "hot")

    def groups_of(cells: DataFrame) -> DataFrame:
        """``grp``, ``id``: members that meet in some cell of several classes."""
        dealt = cells.select("cell", "id", "n", "cls", "entry", "large").repartition(parts, "cell").sortWithinPartitions("cell")
        return dealt.mapInArrow(meet, "grp long, id long").distinct()

    def members_of_cells(hot: DataFrame) -> DataFrame:
        """``id`` and ``cls`` of the texts in mixed crowded cells, read from the sketches, each once."""
        wanted = cells_in(hot, True)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, cls, cell in read(batches):
                there = np.isin(cell, wanted.value).any(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(cls[there])], ["id", "cls"])

        return second.mapInArrow(some, "id long, cls long")

    set_schema = arrow_schema("id long, members binary")

    def members_of(groups: DataFrame) -> DataFrame:
        """``id``, ``members``: the shingle sets that the groups need."""
        marks = spark.sparkContext.broadcast(_bitmap(groups.select(F.xxhash64("id").alias("h")).distinct()))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(sets_of([batch], lambda _, b=batch: _marked(marks.value, b.column(2).to_numpy())))
                for k in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found[k : k + 256]], type=pa.int64()), pa.array([s.tobytes() for _, s in found[k : k + 256]], type=pa.binary())], schema=set_schema)

        return rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(sets, "id long, members binary").groupBy("id").agg(F.min("members").alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, 2):
            ids, a, b = part.column(2).to_numpy(), [], []
            for i, j in bounds(part, 2):
                for x, y in links_of_group([np.frombuffer(s, dtype=np.int64) for s in part.column(3).slice(i, j - i).to_pylist()]):
                    a.append(ids[i + x])
                    b.append(ids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

    def links_in(placed: DataFrame, sets: DataFrame) -> DataFrame:
        meeting = placed.join(sets, "id").select("grp", "block", "id", "members").repartition(parts, "grp", "block").sortWithinPartitions("grp", "block")
        return materialize(meeting.mapInArrow(compare, "a long, b long"), "links")

    def counters(sets: DataFrame) -> np.ndarray:
        """How many shingles of the sets fall to each of a fixed number of counters."""
        kinds = "chunk int, n binary"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(COUNTERS, dtype="<i8")
            for batch in batches:
                members = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64)
                total += np.bincount(members & (COUNTERS - 1), minlength=COUNTERS)
            chunks = total.reshape(-1, CHUNK)
            some = np.flatnonzero(chunks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunks[k].tobytes() for k in some], type=pa.binary())], ["chunk", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[k] = total.get(k, 0) + np.frombuffer(n, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([n.tobytes() for n in total.values()], type=pa.binary())], ["chunk", "n"])

        out = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.int64)
        for r in sets.select("members").mapInArrow(count, kinds).repartition(min(parts, COUNTERS // CHUNK), "chunk").mapInArrow(add, kinds).toLocalIterator():
            out[r.chunk] = np.frombuffer(r.n, dtype="<i8")
        return out.ravel()

    def shelves_of(sets: DataFrame) -> DataFrame:
        """``grp``, ``id``, ``cls``, ``n``, ``rest``: a shingle of the prefix, size of the set, and its members from that shingle on."""
        counts = spark.sparkContext.broadcast(counters(sets))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows_of() -> Iterator[list[np.ndarray]]:
                for batch in batches:
                    for i, cls, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                        members = np.frombuffer(raw, dtype=np.int64)
                        first = prefix(members, counts.value)
                        yield [first, *(np.full(len(first), x) for x in (i, cls, len(members))), len(members) - np.arange(len(first))]

            yield from longs(rows_of(), ["grp", "id", "cls", "n", "rest"])

        return sets.select("id", "cls", "members").mapInArrow(place, "grp long, id long, cls long, n long, rest long")

    def links_of_large(large: DataFrame, known: DataFrame) -> DataFrame:
        """Links that connect what the ``known`` ones do, and all similar sets of ``large`` (``id``, ``cls``)."""
        sets = materialize(members_of(large).join(large, "id"), "sets")
        shelves = materialize(in_mixed(shelves_of(sets)), "shelves")
        loose = links_in(blocks_alone(shelves), sets)
        stars = materialize(components(known.unionByName(loose)).filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "stars")
        rest = shelves.join(stars.select(F.col("a").alias("id"), "b"), "id", "left").select("grp", "id", F.coalesce("b", "id").alias("cls"))
        links = stars.unionByName(links_in(blocks_across(rest), sets))
        release(sets, shelves, loose)
        return links

    hot = crowded(own_cells)
    cold = own_cells.join(F.broadcast(hot.select("cell")), "cell", "left_anti").withColumn("large", F.lit(False))
    warm = own_cells.join(F.broadcast(hot.filter("mixed")), "cell").select(F.col("cell").alias("grp"), "id")
    groups = materialize(groups_of(cold).unionByName(warm), "groups")
    near = links_in(blocks_alone(groups), members_of(groups))
    release(groups)
    classes = components(near).select(F.col("node").alias("id"), "root")
    second = materialize(sketches.join(classes, "id", "left").select("id", "sketch", F.coalesce("root", "id").alias("cls")), "second")
    hot = crowded(rows_of_cells(second))
    groups = materialize(groups_of(rows_of_cells(second, hot)), "groups")
    small = sized(groups, False)
    links = near.unionByName(links_in(small.withColumn("block", F.lit(0)), members_of(small)))
    large = materialize(members_of_cells(hot).unionByName(sized(groups, True).select("id").distinct().join(second, "id").select("id", "cls")).distinct(), "large")
    if not large.isEmpty():
        links = links_of_large(large, links)
    links = materialize(links, "all-links")
    release(near, own_cells, sketches, second, groups, large)
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which each class of near copies has one: that of the smallest id, nulls last."""
    stored, rid, name, drawn = numbered_sets(docs)
    own = stored.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc"), F.col(name).alias("id"), "text", F.col(drawn).alias("sketch"))
    links = similar_links(own)
    roots = components(links)
    classes = own.select("rid", "doc", "id").join(roots, F.col("id") == F.col("node"), "left")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid"))
    first = classes.groupBy(F.coalesce("root", "id")).agg(least.alias("x")).select(F.col("x.rid").alias(rid))
    release(links)
    return stored.join(first, rid, "left_semi").select(*docs.columns)
