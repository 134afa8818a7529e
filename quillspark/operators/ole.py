"""Compound files: a file system in a file, read from binary rows.  Every broken chain or size gives an ``error`` row, never a failed job."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_schema

SCHEMA = "obj_id long, path string, name string, type string, level int, size long, start long, content binary, error string"
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
KINDS = {1: "dir", 2: "file", 5: "root"}


class CompoundFile:
    """Sectors, allocation chains and the directory of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no compound file")
        if len(data) < 512:
            raise ValueError("the header is cut")
        self.data = data
        self.big, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        if not (64 <= self.big <= 65536 and 8 <= self.small <= self.big):
            raise ValueError("sector sizes are wrong")
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini = struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
        places = [x for x in struct.unpack_from("<109I", data, 76) if x < END][:n_fat]
        extra, seen = struct.unpack_from("<I", data, 68)[0], set()
        while extra < END and extra not in seen and len(places) < n_fat:
            seen.add(extra)
            block = self._numbers(self.sector(extra))
            places += [x for x in block[:-1] if x < END][: n_fat - len(places)]
            extra = block[-1]
        self.fat = [x for p in places for x in self._numbers(self.sector(p))]
        self.mini_fat = self._numbers(self.chain(first_mini)) if first_mini < END else []
        self.directory = self.chain(first_dir)
        root = self.entry(0)
        self.mini = self.chain(root["start"]) if root["start"] < END else b""

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def sector(self, k: int) -> bytes:
        at = (k + 1) * self.big
        if at >= len(self.data):
            raise ValueError("a sector is outside of the file")
        return self.data[at : at + self.big]

    def chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < END:
            if k in seen or k >= len(self.fat):
                raise ValueError("a sector chain is broken")
            seen.add(k)
            out.append(self.sector(k))
            k = self.fat[k]
        return b"".join(out)

    def mini_chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < END:
            if k in seen or k >= len(self.mini_fat):
                raise ValueError("a small chain is broken")
            seen.add(k)
            out.append(self.mini[k * self.small : (k + 1) * self.small])
            k = self.mini_fat[k]
        return b"".join(out)

    def entry(self, k: int) -> dict:
        raw = self.directory[128 * k : 128 * (k + 1)]
        if len(raw) < 128:
            raise ValueError("a directory entry is missing")
        n = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<3I", raw, 68)
        start, size = struct.unpack_from("<2I", raw, 116)
        return {"name": raw[: max(0, n - 2)].decode("utf-16-le", "replace"), "type": raw[66], "left": left, "right": right, "child": child, "start": start, "size": size}

    def content(self, e: dict) -> bytes:
        data = self.chain(e["start"]) if e["size"] >= self.cutoff else self.mini_chain(e["start"]) if e["size"] else b""
        if len(data) < e["size"]:
            raise ValueError("a stream is cut")
        return data[: e["size"]]

    def walk(self) -> Iterator[tuple[str, int, dict]]:
        """Path, level and entry of everything, siblings in order, children after their folder."""
        todo, seen = [(0, "", 0)], set()
        while todo:
            k, above, level = todo.pop()
            if k in seen or k == FREE:
                continue
            seen.add(k)
            e = self.entry(k)
            path = "/" if e["type"] == 5 else f"{above}/{e['name']}"
            yield path, level, e
            below = self._siblings(e["child"])
            todo += [(c, "" if e["type"] == 5 else path, level + 1) for c in reversed(below)]

    def _siblings(self, k: int) -> list[int]:
        out, stack, seen = [], [], set()
        while stack or (k != FREE and k not in seen):
            while k != FREE and k not in seen:
                seen.add(k)
                stack.append(k)
                k = self.entry(k)["left"]
            k = stack.pop()
            out.append(k)
            k = self.entry(k)["right"]
        return out


def list_entries(data: bytes) -> list[dict]:
    """Rows of ``SCHEMA`` but ``obj_id`` for one file."""
    try:
        f = CompoundFile(data)
        out = []
        for path, level, e in f.walk():
            row = {"path": path, "name": e["name"], "type": KINDS.get(e["type"], "unknown"), "level": level, "size": e["size"], "start": e["start"], "content": None, "error": None}
            if e["type"] == 2:
                try:
                    row["content"] = f.content(e)
                except ValueError as x:
                    row["error"] = str(x)
            out.append(row)
        return out
    except (ValueError, struct.error) as x:
        return [{"path": None, "name": None, "type": None, "level": None, "size": None, "start": None, "content": None, "error": str(x)}]


def entries(objects: DataFrame, key: str = "obj_id", content: str = "data") -> DataFrame:
    """Rows of ``SCHEMA`` for every object."""
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for obj_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [r | {"obj_id": obj_id} for r in list_entries(data or b"")]
                size += len(data or b"")
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in schema], schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in schema], schema=schema)

    return objects.select(F.col(key).cast("long").alias("obj_id"), F.col(content).alias("data")).mapInArrow(run, SCHEMA)


def open_stream(rows: DataFrame, path: str) -> DataFrame:
    """The entry at an absolute path of every object."""
    return rows.filter(F.col("path") == path)


def read_at(content: Column, offset: Column, size: Column, whence: str = "start", position: Column | None = None) -> Column:
    """Bytes of a stream from an offset counted from its ``start``, its ``end`` (backwards), or forwards or ``back`` from a position; null where the place
    is outside of the stream."""
    n = F.octet_length(content)
    here = F.lit(0) if position is None else position
    at = {"start": offset, "end": n - offset, "forward": here + offset, "back": here - offset}[whence]
    return F.when((at >= 0) & (at <= n), F.substring(content, at.cast("int") + 1, size.cast("int")))


def visit(rows: DataFrame, folders=None, files=None) -> DataFrame:
    """Entries with ``visited``: what a caller's column expressions make of folders and of files."""
    is_folder = F.col("type").isin("root", "dir")
    return rows.withColumn("visited", F.when(is_folder, folders if folders is not None else F.lit(None).cast("string")).otherwise(files if files is not None else F.lit(None).cast("string")))


def tree_line(name: Column, kind: Column, level: Column, size: Column) -> Column:
    """An entry as a line of a printed tree, indented by its level."""
    return F.concat(F.repeat(F.lit("  "), level), name, F.when(kind == "file", F.concat(F.lit(" ("), size.cast("string"), F.lit(")"))).otherwise(F.lit("/")))


def error_code(error: Column) -> Column:
    """A short code of an ``error``: what part of the file is broken."""
    out = F.when(error.isNotNull(), "other")
    for part, code in reversed(ERROR_PARTS):
        out = F.when(error.contains(part), code).otherwise(out)
    return out


#: Words of the errors, and their codes.
ERROR_PARTS = (("compound", "magic"), ("header", "header"), ("sizes", "header"), ("sector chain", "chain"), ("small chain", "small_chain"), ("directory", "directory"), ("sector", "sector"), ("is cut", "cut"))


def write_compound(streams: dict[str, bytes], small: bool = False) -> bytes:
    """A compound file with the given streams below its root; for fixtures and round trips.  Streams go to big sectors, or those of
    less than 4096 bytes to small ones."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        start = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        for k, p in enumerate(parts):
            sectors.append(p)
            fat.append(start + k + 1 if k + 1 < len(parts) else END)
        return start

    names = sorted(streams)
    mini, mini_fat, places_of = b"", [], {}
    for n in names:
        if small and 0 < len(streams[n]) < 4096:
            count, first = -(-len(streams[n]) // 64), len(mini_fat)
            mini += streams[n].ljust(64 * count, b"\0")
            mini_fat += [*range(first + 1, first + count), END]
            places_of[n] = (first, len(streams[n]))
        else:
            places_of[n] = (put(streams[n].ljust(4096, b"\0")), max(4096, len(streams[n])))
    mini_start = put(mini) if mini else END
    mini_table = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini else END
    if mini:  # unused places of the last sector of the small chains
        sectors[-1] = sectors[-1][: 4 * len(mini_fat) % 512 or 512].ljust(512, b"\xff")

    def record(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, FREE, right, child) + b"\0" * 36 + struct.pack("<3I", start, size, 0)

    directory = record("Root Entry", 5, FREE, 1 if names else FREE, mini_start, len(mini))
    for k, n in enumerate(names):
        directory += record(n, 2, k + 2 if k + 1 < len(names) else FREE, FREE, *places_of[n])
    first_dir = put(directory)
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * 512:
        n_fat += 1
    places = list(range(len(sectors), len(sectors) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512 * n_fat, b"\xff")
    n_mini = -(-len(mini_fat) * 4 // 512)
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", n_fat, first_dir, 0, 4096, mini_table, n_mini, END, 0)
    head += struct.pack("<109I", *(places + [FREE] * 109)[:109])
    return head.ljust(512, b"\0") + b"".join(sectors) + table
