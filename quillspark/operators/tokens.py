"""Tokens of rich text: scanning, classification, nesting, look-ahead, groups.

Scanning is lossless: the tokens of a document joined in order are the document.  It runs in the JVM without a shuffle;
only window operators (nesting, look-ahead) bring a document's tokens together, by its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import from_byte, from_code
from ..joins import keyed, small

PATTERN = r"\\[a-zA-Z]+-?[0-9]* ?|\\'[0-9a-fA-F]{2}|\\[^a-zA-Z]|[{}]|[^\\{}]+|\\"
GROUP, TEXT, CONTROL = 1, 2, 3
#: Control words that stand for characters.
CHARACTERS = {
    "par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
    "bullet": "•", "emspace": " ", "enspace": " ",
}


def tokenize(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``key``, ``pos``, ``tok``, ``cls``, ``word``, ``param``; binary contents are read byte by byte as Latin-1."""
    text = F.decode(F.col(content), "ISO-8859-1") if docs.schema[content].dataType.simpleString() == "binary" else F.col(content)
    return _described(docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pos", "tok")), key)


def _described(each: DataFrame, key: str) -> DataFrame:
    """``key``, ``pos``, ``tok`` with class, word and parameter."""
    tok = F.col("tok")
    cls = F.when(tok.isin("{", "}"), GROUP).when(tok.startswith("\\"), CONTROL).otherwise(TEXT)
    letters = F.regexp_extract(tok, r"^\\([a-zA-Z]+)", 1)
    word = F.when(cls == CONTROL, F.when(letters != "", letters).otherwise(F.substring(tok, 2, 1)))
    param = F.expr("try_cast(nullif(regexp_extract(tok, '^\\\\\\\\[a-zA-Z]+(-?[0-9]+)', 1), '') as int)")
    return each.select(key, "pos", "tok", cls.alias("cls"), word.alias("word"), param.alias("param"))


def classify(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens with ``major`` and ``minor`` of their word; nulls where the dictionary lacks it."""
    return tokens.join(small(dictionary), "word", "left")


def unknown(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Control words that the dictionary lacks."""
    words = tokens.filter((F.col("cls") == CONTROL) & F.col("word").rlike("^[a-zA-Z]+$"))
    return words.join(small(dictionary), "word", "left_anti")


def with_depth(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``depth``: open groups after each token."""
    step = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    return tokens.withColumn("depth", F.sum(step).over(Window.partitionBy(key).orderBy("pos")).cast("int"))


def balance(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: deepest nesting, nesting at the end, and whether it ever falls below zero."""
    d = with_depth(tokens, key)
    return d.groupBy(key).agg(F.max("depth").alias("max_depth"), F.sum(F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)).cast("int").alias("end_depth"), (F.min("depth") < 0).alias("underflow"))


def groups(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``open_pos``, ``close_pos`` (null if never closed), ``level``, ``destination`` (first word), ``optional``."""
    d = with_depth(keyed(tokens, key), key)
    order = Window.partitionBy(key).orderBy("pos")
    nxt = d.withColumns({"w1": F.lead("word").over(order), "w2": F.lead("word", 2).over(order)})
    braces = nxt.filter(F.col("cls") == GROUP).withColumn("level", F.when(F.col("tok") == "{", F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy(key, "level").orderBy("pos")
    closed = F.lead(F.when(F.col("tok") == "}", F.col("pos"))).over(level)
    paired = braces.withColumn("close_pos", closed).filter(F.col("tok") == "{")
    star = F.coalesce(F.col("w1") == "*", F.lit(False))
    return paired.select(key, F.col("pos").alias("open_pos"), "close_pos", "level", F.when(star, F.col("w2")).otherwise(F.col("w1")).alias("destination"), star.alias("optional"))


def skip_groups(tokens: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens outside of the given groups: a count of open skipped groups runs along the tokens, so nothing is joined."""
    opens = ranges.select(key, F.col("open_pos").alias("pos"), F.lit(1).alias("step"))
    closes = ranges.filter(F.col("close_pos").isNotNull()).select(key, (F.col("close_pos") + 1).alias("pos"), F.lit(-1).alias("step"))
    marked = keyed(tokens.unionByName(opens.unionByName(closes), allowMissingColumns=True), key)  # a step stands before the token of its place
    inside = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(key).orderBy("pos", F.col("step").isNull()))
    return marked.withColumn("inside", inside).filter("inside = 0 and step is null").drop("inside", "step")


def within_groups(tokens: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of the given groups, which must not overlap; ``open_pos`` names the group."""
    opens = ranges.select(key, F.col("open_pos").alias("pos"), "open_pos", "close_pos")
    marked = tokens.join(opens, [key, "pos"], "left")
    order = Window.partitionBy(key).orderBy("pos")
    at = marked.withColumns({"open_pos": F.last("open_pos", True).over(order), "close_pos": F.last("close_pos", True).over(order)})
    return at.filter(F.col("pos") <= F.coalesce("close_pos", F.lit(2147483647))).filter(F.col("open_pos").isNotNull())


def peek(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with ``next_tok`` and ``prev_tok``."""
    order = Window.partitionBy(key).orderBy("pos")
    return tokens.withColumns({"next_tok": F.lead("tok").over(order), "prev_tok": F.lag("tok").over(order)})


def skip_to_level(tokens: DataFrame, position: int, level: int, key: str = "doc_id") -> DataFrame:
    """Tokens from the first one after ``position`` that leaves the document at ``level`` open groups or fewer."""
    d = with_depth(tokens, key)
    order = Window.partitionBy(key).orderBy("pos")
    reached = F.max(((F.col("pos") > position) & (F.col("depth") <= level)).cast("int")).over(order)
    return d.withColumn("reached", reached).filter("reached = 1").drop("reached", "depth")


def skip_to_token(tokens: DataFrame, position: int, tok: str, key: str = "doc_id") -> DataFrame:
    """Tokens from the first ``tok`` after ``position``."""
    order = Window.partitionBy(key).orderBy("pos")
    reached = F.max(((F.col("pos") > position) & (F.col("tok") == tok)).cast("int")).over(order)
    return tokens.withColumn("reached", reached).filter("reached = 1").drop("reached")


def unknown_groups(ranges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Optional groups whose destination the dictionary lacks; those are to be skipped, known ones are not."""
    return ranges.filter("optional").join(small(dictionary.select(F.col("word").alias("destination"))), "destination", "left_anti")


def insert(tokens: DataFrame, where: Column, texts: list[str], key: str = "doc_id") -> DataFrame:
    """Tokens with made-up ones after every token for which ``where`` holds; positions are counted anew."""
    made = F.transform(F.array(*[F.lit(t) for t in texts]), lambda t: t)
    all_ = F.concat(F.array("tok"), F.when(where, made).otherwise(F.array().cast("array<string>")))
    each = tokens.select(key, F.col("pos").alias("p"), F.posexplode(all_).alias("k", "tok"))
    numbered = each.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy("p", "k")) - 1).cast("int"))
    return _described(numbered.select(key, "pos", "tok"), key)


def route(tokens: DataFrame, branches: dict[str, Column], other: str = "other") -> DataFrame:
    """Tokens with ``branch``, the name of the first condition that holds."""
    out = F.lit(other)
    for name, condition in reversed(branches.items()):
        out = F.when(condition, name).otherwise(out)
    return tokens.withColumn("branch", out)


def with_hook(tokens: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tokens after a caller's function, which sees every one of them."""
    return tokens.transform(hook)


def next_word(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with ``next_text``: the next text token that is not white space."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    solid = F.when((F.col("cls") == TEXT) & F.col("tok").rlike(r"\S"), F.trim("tok"))
    return tokens.withColumn("next_text", F.first(solid, True).over(order))


def is_rich_text(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``ok``: the second token is the version word, with a version of 1 or none."""
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    second = tokens.filter("pos < 2").groupBy(key).agg(at(1, "word").alias("w"), at(1, "param").alias("v"), at(0, "tok").alias("t"))
    return second.select(key, F.coalesce((F.col("w") == "rtf") & (F.col("t") == "{") & (F.coalesce("v", F.lit(1)) == 1), F.lit(False)).alias("ok"))


def piece(charset: str = "cp1252") -> Column:
    """The text a token stands for, given ``tok``, ``cls``, ``word``, ``param``, but for Unicode escapes."""
    tok, word = F.col("tok"), F.col("word")
    out = F.when(F.col("cls") == TEXT, F.regexp_replace(tok, "[\r\n]", ""))
    out = out.when(tok.startswith("\\'"), from_byte(F.substring(tok, 3, 2), charset))
    out = out.when(tok.isin("\\{", "\\}", "\\\\"), word).when(tok == "\\~", F.lit("\u00a0")).when(tok == "\\_", F.lit("\u2011"))
    out = out.when(tok.isin("\\\n", "\\\r"), F.lit("\n"))
    for w, c in CHARACTERS.items():
        out = out.when(word == w, F.lit(c))
    return out.otherwise(F.lit(""))


def plain_text(tokens: DataFrame, key: str = "doc_id", charset: str = "cp1252") -> DataFrame:
    """``key``, ``text`` of flat documents: the pieces of a document in order.  The stand-ins after a Unicode escape are skipped, as
    many as the last ``\\uc`` says; a brace ends them.  Pairs of escapes make one character.  Rows of one id are one document."""
    order = Window.partitionBy(key).orderBy("pos")
    escape = (F.col("word") == "u") & F.col("param").isNotNull() & (F.col("cls") == CONTROL)
    marked = tokens.select(key, "pos", "tok", "cls", "word", "param", escape.alias("esc"))
    marked = marked.withColumns({
        "uc": F.coalesce(F.last(F.when((F.col("word") == "uc") & (F.col("cls") == CONTROL), F.col("param")), True).over(order), F.lit(1)),
        "since": F.sum(F.col("esc").cast("int")).over(order),
        "code_before": F.last(F.when(F.col("esc"), F.col("param")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "code_after": F.first(F.when(F.col("esc"), F.col("param")), True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    plain = F.regexp_replace("tok", "[\r\n]", "")
    size = F.when(F.col("esc"), 0).when(F.col("cls") == GROUP, 1 << 20).when(F.col("cls") == TEXT, F.char_length(plain)).when(F.col("tok").startswith("\\'"), 1).otherwise(1 << 20)
    before = F.sum(size).over(Window.partitionBy(key, "since").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    left = F.when(F.col("since") > 0, F.greatest(F.lit(0), F.col("uc") - F.coalesce(before, F.lit(0)))).otherwise(0)
    whole = lambda c: F.when(c < 0, c + 65536).otherwise(c)
    second = whole(F.col("param")).between(0xDC00, 0xDFFF) & F.coalesce(whole(F.col("code_before")).between(0xD800, 0xDBFF), F.lit(False))
    shown = F.when(F.col("esc") & second, F.lit("")).when(F.col("esc"), from_code(F.col("param"), F.coalesce("code_after", F.lit(0))))
    shown = shown.when((left > 0) & (F.col("cls") == TEXT), F.substring(plain, left + 1, F.char_length(plain)))
    shown = shown.when((left > 0) & F.col("tok").startswith("\\'"), F.lit("")).otherwise(piece(charset))
    p = marked.select(key, "pos", shown.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return p.groupBy(key).agg(joined.alias("text"))


def _piece_of(tok: Column, charset: str) -> Column:
    """:func:`piece` of a bare token, for use within an array."""
    named = F.create_map(*[F.lit(x) for pair in CHARACTERS.items() for x in pair])
    word = F.regexp_extract(tok, r"^\\([a-zA-Z]+)", 1)
    control = F.when(tok.startswith("\\'"), from_byte(F.substring(tok, 3, 2), charset)).when(tok.isin("\\{", "\\}", "\\\\"), F.substring(tok, 2, 1))
    control = control.when(tok == "\\~", F.lit("\u00a0")).when(tok == "\\_", F.lit("\u2011")).when(tok.isin("\\\n", "\\\r"), F.lit("\n")).otherwise(F.coalesce(F.element_at(named, word), F.lit("")))
    return F.when(tok.startswith("\\"), control).when(tok.isin("{", "}"), F.lit("")).otherwise(F.translate(tok, "\r\n", ""))


def document_text(docs: DataFrame, key: str = "doc_id", content: str = "rtf", charset: str = "cp1252") -> DataFrame:
    """``key``, ``text`` of flat documents, one row a row.  A document without Unicode escapes is decoded in place, token by token, and not
    shuffled; only the others take the way of :func:`plain_text`, a null document gives an empty text."""
    text = F.decode(F.col(content), "ISO-8859-1") if docs.schema[content].dataType.simpleString() == "binary" else F.col(content)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("rtf"), F.monotonically_increasing_id().alias("row"))  # the number keeps the filters above what makes the text
    plain = ~F.col("rtf").rlike(r"\\u-?[0-9]")
    found = F.regexp_extract_all("rtf", F.lit(PATTERN), F.lit(0))
    here = rows.filter(plain).select(key, F.array_join(F.transform(found, lambda t: _piece_of(t, charset)), "").alias("text"))
    with_key = rows.filter(~plain).select(F.struct(key, "row").alias("at"), "rtf")
    rest = plain_text(tokenize(with_key, "at"), "at", charset)
    return here.unionByName(rest.select(F.col(f"at.{key}").alias(key), "text"))


def runs(tokens: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """Runs of equal ``column``: ``key``, ``run``, ``first_pos``, ``last_pos``, the value and ``n``."""
    order = Window.partitionBy(key).orderBy("pos")
    changed = (~F.col(column).eqNullSafe(F.lag(column).over(order)) | (F.row_number().over(order) == 1)).cast("int")
    run = tokens.withColumn("_c", changed).withColumn("run", F.sum("_c").over(order).cast("int"))
    return run.groupBy(key, "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.first(column).alias(column), F.count("*").alias("n"))
