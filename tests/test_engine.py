"""Rich-text operators on small inputs, round trips and malformed documents."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark import queries
from quillspark.operators import mtef, ole, state, tokens
from quillspark.plans.options import Options, parse_arguments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import os

    con = duckdb.connect()
    for t in os.listdir(SF):
        p = f"{SF}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_tokens_are_lossless(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("{}\\ab1 -'\n;*é") for _ in range(rng.randrange(60)))) for i in range(200)]
    t = tokens.tokenize(spark.createDataFrame(docs, "doc_id long, rtf string")).orderBy("doc_id", "pos").collect()
    joined = {}
    for r in t:
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.tok
    assert all(joined.get(i, "") == x for i, x in docs)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, exclude_categories=("Cs",)), max_size=80))
def test_machine_reads_what_is_escaped(text):
    units = lambda c: [int.from_bytes(c.encode("utf-16-le")[k : k + 2], "little") for k in range(0, len(c.encode("utf-16-le")), 2)]
    body = "".join(f"\\{c}" if c in "\\{}" else c if c < "\x7f" else "".join(f"\\u{n - 65536 if n > 32767 else n}?" for n in units(c)) for c in text)
    m = state.Machine(("{\\rtf1 " + body + "}").encode("latin-1")).run()
    assert m.error is None and "".join(r["text"] for r in m.rows) == text


@pytest.mark.parametrize("data", [b"", b"{}", b"{\\rtf}x", b"junk{\\rtf1 a}", b"{\\rtf1 a}}", b"{\\rtf1 {a}", b"{\\rtf2 a}", b"{\\foobar}", b"a", b"{\\rtf1 \\bin999999 "])
def test_malformed_documents_give_errors(data):
    assert state.Machine(data).run().error


def test_state_details():
    m = state.Machine(b"{\\rtf1\\ansicpg1251{\\*\\unknown hidden}{\\fonttbl{\\f0\\fcharset204 A;}}\\f0 \\'cf\\bin3 }}}\\super x\\nosupersub\\\ny}").run()
    assert m.error is None
    assert [(r["text"], r["script"], r["par"]) for r in m.rows] == [("П", 0, 0), ("x", 1, 0), ("y", 0, 1)]


def test_compound_file_round_trip_and_damage():
    made = ole.write_compound({"a": b"x" * 5000, "b": b"y" * 9000})
    rows = {r["path"]: r for r in ole.list_entries(made)}
    assert rows["/a"]["content"][:5000] == b"x" * 5000 and rows["/b"]["content"] == b"y" * 9000
    rng = random.Random(2)
    for _ in range(200):
        broken = bytearray(made)
        for _ in range(4):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        ole.list_entries(bytes(broken[: rng.randrange(len(broken))]))
    assert ole.list_entries(b"")[0]["error"]


def test_equations():
    head = bytes([5, 1, 0, 5, 0, 65, 0, 0])
    char = lambda c, face=131: bytes([2, 0, face, ord(c) & 255, ord(c) >> 8])
    line = lambda *parts: bytes([1, 0]) + b"".join(parts) + b"\0"
    root = head + line(bytes([3, 0, 10, 0, 0]) + line(char("x")) + b"\0") + b"\0"
    assert mtef.to_latex(root)["latex"] == "\\sqrt{x}"
    fence = head + line(bytes([3, 0, 1, 3, 0]) + line(*(char(c, 130) for c in "sin"), char("θ")) + b"\0") + b"\0"
    assert mtef.to_latex(fence)["latex"] == "\\left( \\sin \\theta \\right)"
    pile = head + bytes([4, 0, 4, 0]) + line(char("a"), char("="), char("b")) + b"\0\0"
    assert mtef.to_latex(pile)["latex"] == "a & = & b"
    rng = random.Random(3)
    for _ in range(500):
        mtef.to_latex(bytes(rng.randrange(256) for _ in range(rng.randrange(40))))
    assert mtef.to_latex(b"\x09")["error"]


def test_options():
    assert parse_arguments(["-bT2", "-p", "16", "--", "-x"]) == ({"paragraph": 16, "text": 7, "equation": 1, "table": 2}, ["-x"])
    done, warned = Options().with_file("# c\nfragment true\npage_width 7.5\nnone 1\n")
    assert done.fragment and done.page_width == 7.5 and warned == ["none"]


def test_folder_source_and_stream(spark, tmp_path):
    from quillspark.sources.files import read_documents
    from quillspark.streaming.watch import token_stream, watch

    (tmp_path / "a.rtf").write_bytes(b"{\\rtf1 a}")
    (tmp_path / "b.txt").write_bytes(b"b")
    rows = {r.name: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.rtf"].error is None and rows["b.txt"].error
    q = token_stream(watch(spark, str(tmp_path))).writeStream.format("memory").queryName("toks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM toks WHERE path LIKE '%a.rtf'").first()[0] == 4


def test_any_text_as_a_document(spark):
    from quillspark.functions.text import rtf_encode
    from quillspark.plans.render import to_latex

    rng = random.Random(4)
    some = [chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(32, 300)])) for _ in range(3000)]
    texts = ["".join(rng.choices(some, k=rng.randrange(40))) for _ in range(150)] + ["", "\u2028", "\x80\x9f\xa0\xad\xff"]
    plain = [t.translate({ord(c): None for c in "\\\\{}"}) for t in texts]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    df = df.selectExpr("doc_id", "text")
    from pyspark.sql import functions as F

    written = df.select("doc_id", rtf_encode(F.col("text")).alias("rtf"))
    assert {r.doc_id: r.text for r in tokens.plain_text(tokens.tokenize(written)).collect()} == dict(enumerate(plain))
    raw = df.select("doc_id", F.concat(F.lit("{\\rtf1\\ansicpg28591 "), "text", F.lit("}")).alias("rtf"))
    assert {r.doc_id for r in to_latex(raw).collect() if r.error is None} == set(range(len(plain)))


def test_lone_and_paired_halves():
    read = lambda b: "".join(r["text"] for r in state.Machine(b"{\\rtf1 " + b + b"}").run().rows)
    assert read(b"\\u-10179?\\u-9138?") == chr(0x1F44E) and read(b"\\u-9138?a") == "\ufffda" and read(b"a\\u-10179?") == "a\ufffd"
    assert read(b"\\u-10179?\\u-10179?\\u-9138?") == "\ufffd" + chr(0x1F44E) and read(b"{\\u-10179?}\\u-9138?") == "\ufffd\ufffd"
    assert read(b"\\uc3\\u65abcd") == "Ad" and read(b"\\uc2\\u65\\'41\\'42c") == "Ac"


def test_pictures_objects_and_damage():
    m = state.Machine(b"{\\rtf1{\\pict\\pngblip 8 9 5\n0}{\\object{\\*\\objclass X}{\\*\\objdata 0102}{\\result r}}{\\pict").run()
    assert m.error and state.hex_bytes(m.pictures[0]["hex"]) == b"\x89\x50" and m.objects[0]["class"] == "X" and "r" in [r["text"] for r in m.rows]
    rng = random.Random(5)
    words = [b"{", b"}", b"\\pict ", b"\\trowd", b"\\cellx9", b"\\cell ", b"\\row", b"\\intbl ", b"\\pard ", b"\\field ", b"{\\*\\fldinst EQ \\\\f(", b"\\fldrslt ", b"\\bin4 ", b"a", b"\\u-10179?", b"\\objdata ", b"\\footnote ", b"{\\*\\bkmkstart b}"]
    from quillspark.plans.render import Writer

    for _ in range(600):
        m = state.Machine(b"{\\rtf1 " + b"".join(rng.choices(words, k=rng.randrange(30))) + b"}").run()
        m.tables()
        Writer(m, Options(paragraph=63, table=7)).document()


def test_compound_files_with_small_streams_and_damage():
    rng = random.Random(6)
    for _ in range(40):
        streams = {f"s{k}": rng.randbytes(rng.choice([1, 63, 64, 65, 700, 4095, 4096, 9000])) for k in range(rng.randrange(1, 6))}
        rows = {r["name"]: r["content"] for r in ole.list_entries(ole.write_compound(streams, small=True)) if r["type"] == "file"}
        assert all(rows[n][: len(d)] == d and (len(d) >= 4096 or len(rows[n]) == len(d)) for n, d in streams.items())


def test_template_slots():
    assert mtef.slot_target(mtef.TEMPLATES[True, 29, 0], 1) == "line" and mtef.slot_target(mtef.TEMPLATES[False, 14, 0], 2) == "math" and not mtef.slot_target("x", 1)
    assert not any(f.count('<1>') > 1 for f in mtef.TEMPLATES.values())


def test_style_chains(spark):
    from quillspark.operators.lookups import style_chain

    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 5, 5), (2, 7, 9), (None, 1, None), (1, 2, 1)]
    got = {(r.doc_id, r.num, r.depth, r.ancestor) for r in style_chain(spark.createDataFrame(rows, "doc_id long, num int, based_on int")).collect()}
    assert got == {(1, 0, 0, 0), (1, 1, 0, 1), (1, 1, 1, 0), (1, 2, 0, 2), (1, 2, 1, 1), (1, 2, 2, 0), (2, 1, 0, 1), (2, 1, 1, 2), (2, 2, 0, 2), (2, 2, 1, 1), (2, 5, 0, 5), (2, 7, 0, 7), (None, 1, 0, 1)}


def test_files_in_and_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.operators import maps
    from quillspark.sources import files

    (tmp_path / "in/x.rtfd").mkdir(parents=True)
    (tmp_path / "in/y").mkdir()
    (tmp_path / "in/x.rtfd/TXT.rtf").write_bytes(b"{\\rtf1 a}")
    (tmp_path / "in/x.rtfd/image.png").write_bytes(b"png")
    for f in ("in/a.rtf", "in/y/a.rtf"):
        (tmp_path / f).write_bytes(b"{\\rtf1 " + f.encode() + b"{\\pict\\pngblip 0102}}")
    assert files.resolve(str(tmp_path / "in/a")).endswith("a.rtf") and files.resolve(str(tmp_path / "in/x")).endswith("TXT.rtf") and files.resolve(str(tmp_path / "in/z")) is None
    assert [r.name for r in files.bundle_images(spark, str(tmp_path / "in")).collect()] == ["image.png"]
    docs = files.read_documents(spark, str(tmp_path / "in"), "*.rtf").withColumn("doc_id", F.xxhash64("path"))
    from quillspark.plans.render import to_latex

    done = to_latex(docs).join(docs.select("doc_id", "out_path"), "doc_id")
    root = str(tmp_path / "in")
    assert files.write_latex(done, str(tmp_path / "out"), root).count() == 3
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.tex")} == {"a.tex", "y/a.tex", "x-latex/x.tex"}
    assert "in/y/a.rtf" in (tmp_path / "out/y/a.tex").read_text()
    shown = state.pictures(docs).join(docs.select("doc_id", "out_path"), "doc_id").withColumn("out_path", files.picture_path(F.col("out_path"), F.col("num"), F.col("kind")))
    files.write_files(shown, str(tmp_path / "out"), content="content", root=root).count()
    assert (tmp_path / "out/y/picture-0.png").read_bytes() == b"\x01\x02"
    (tmp_path / "cs").write_text("# c\n\na 65\nb 0x41\n")
    assert [tuple(r) for r in maps.charset_map(maps.read_lines(spark, str(tmp_path / "cs"))).collect()] == [(65, "b")]
    assert maps.find_resource("cs", [str(tmp_path)]) == str(tmp_path / "cs")
    (tmp_path / "dict").write_text('3 9\n1 2 "a"\n')
    with pytest.raises(ValueError):
        maps.parse_dictionary(maps.read_lines(spark, str(tmp_path / "dict")))
    with pytest.raises(FileNotFoundError):
        maps.find_resource("none", [str(tmp_path)])


def test_preference_files():
    done, warned = Options().with_file("convertTextColor false\nconvertTableBorders true\npreambleDocClass '\\documentclass{book}'\npageWidth 7\nconvertPict no\nfoo 1\n")
    assert (done.text, done.table, done.document_class, done.page_width, done.pictures, warned) == (5, 7, "book", 7.0, False, ["foo"])
    assert Options().preset("best").paragraph == 63


def test_machine_work_per_row():
    """Calls that a table row and its LaTeX take: time at size is theirs (207 and 103 before)."""
    import sys

    from quillspark.plans.render import Writer

    def calls(n, make, use):
        data, seen = make(n), [0]
        sys.setprofile(lambda frame, event, what: seen.__setitem__(0, seen[0] + event.endswith("call")))
        try:
            use(data)
        finally:
            sys.setprofile(None)
        return seen[0]

    each = lambda make, use: (calls(60, make, use) - calls(20, make, use)) / 40
    rows = lambda n: b"{\\rtf1 a\\par " + b"\\trowd\\cellx1000\\cellx2000\\cellx3000\\pard\\intbl 17\\cell{\\b A}\\cell O\\cell \\row" * n + b"\\pard b}"
    assert each(rows, lambda d: state.Machine(d).run().tables()) < 190
    assert each(lambda n: state.Machine(rows(n)).run(), lambda m: Writer(m, Options(fragment=True, table=1)).document()) < 90


def test_parsed_rows_are_handed_on_in_slices(spark, monkeypatch):
    from quillspark.operators import state as st_

    seen = []
    docs = spark.createDataFrame([(i, "{\\rtf1" + "{\\pict 41}" * 30 + "}") for i in range(50)], "doc_id long, rtf string")
    assert state.pictures(docs.coalesce(1)).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism  # 1 before
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kinds: seen.append(run))
    monkeypatch.setattr(st_, "ROWS_AT_ONCE", 100)
    st_.pictures(docs)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])
    made = list(seen[0](iter([batch])))
    assert max(b.num_rows for b in made) < 130 and sum(b.num_rows for b in made) == 1500
    assert [x for b in made for x in b.column(0).to_pylist()] == [i for i in range(50) for _ in range(30)]


def test_groups_and_skips_are_dealt_by_document_alone(spark):
    docs = spark.createDataFrame([(1, "{\\rtf1{\\*\\x a{b}}c{\\*\\y d}{\\*\\z e}f}"), (2, "{\\rtf1 g{\\*\\x h"), (3, "")], "doc_id long, rtf string")
    t = tokens.tokenize(docs)
    optional = tokens.groups(t).filter("optional")
    assert optional.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism  # put together to one by its small size before
    kept = tokens.skip_groups(t, optional)
    assert kept.columns == t.columns and {r.doc_id: r.text for r in tokens.plain_text(kept).collect()} == {1: "cf", 2: "g"}
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()  # a join held both sides sorted in one task
