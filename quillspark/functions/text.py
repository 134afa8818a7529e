"""String, path, unit and hex functions, all as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TWIPS_PER_INCH = 1440
#: Characters that LaTeX reserves, and how they are written.
LATEX_SPECIALS = (
    ("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("#", "\\#"), ("$", "\\$"), ("%", "\\%"), ("&", "\\&"), ("_", "\\_"),
    ("^", "\\^{}"), ("~", "\\~{}"), ("<", "$<$"), (">", "$>$"), ("|", "$|$"),
)
#: File kinds by extension.
KINDS = {"rtf": "rtf", "rtfd": "rtfd", "eqn": "eqn", "rqn": "raw_eqn"}


def latex_escape(text: Column) -> Column:
    """Text with every reserved character written for LaTeX.  One pass, so that what a rule writes is not read again."""
    marked = text
    for k, (plain, _) in enumerate(LATEX_SPECIALS):
        marked = F.replace(marked, F.lit(plain), F.lit(chr(0xE000 + k)))  # private-use marks
    for k, (_, written) in enumerate(LATEX_SPECIALS):
        marked = F.replace(marked, F.lit(chr(0xE000 + k)), F.lit(written))
    return marked


WIDE = r"[^\x00-\xFF]"


def unicode_escapes(text: Column) -> Column:
    """``text`` with every character beyond Latin-1 written as ``\\uN?``, as two of them beyond 16 bits."""
    unit = lambda n: F.concat(F.lit("\\u"), F.when(n > 32767, n - 65536).otherwise(n).cast("string"), F.lit("?"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        above = n - 65536
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(1023)) + 0xDC00))
        return F.when(n < 256, c).when(n < 65536, unit(n)).otherwise(pair)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def bytes_of(content: str | bytes | None) -> bytes:
    """A document as bytes: of one kept as text one a character, and escapes for what has no byte, so that no text fails."""
    if content is None or isinstance(content, (bytes, bytearray)):
        return bytes(content or b"")
    try:
        return content.encode("latin-1")
    except UnicodeEncodeError:
        units = lambda c: memoryview(c.encode("utf-16-le", "surrogatepass")).cast("H")
        return re.sub(WIDE, lambda m: "".join(f"\\u{n - 65536 if n > 32767 else n}?" for n in units(m[0])), content).encode("latin-1")


def rtf_encode(text: Column) -> Column:
    """A flat RTF document that holds ``text``; line feeds become paragraphs, Latin-1 letters hex escapes, all beyond Unicode escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    out = F.replace(F.replace(out, F.lit("\n"), F.lit("\\par ")), F.lit("\t"), F.lit("\\tab "))
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit("[\\xA1-\\xFF]"), F.lit(0)))  # few in any one text
    hexed = F.aggregate(letters, out, lambda acc, c: F.replace(acc, c, F.concat(F.lit("\\'"), F.lower(F.hex(F.ascii(c))))))
    out = F.when(text.rlike(WIDE), unicode_escapes(hexed)).when(F.octet_length(text) > F.char_length(text), hexed).otherwise(out)
    return F.concat(F.lit("{\\rtf1\\ansi "), out, F.lit("}"))


def from_code(code: Column, following: Column | None = None) -> Column:
    """Character of a signed 16-bit code: negative numbers count from 65536.  The first half of a pair needs ``following``, the next code;
    the second half gives nothing after a first one (``following`` is then the code before).  A lone half gives U+FFFD."""
    whole = lambda c: F.when(c < 0, c + 65536).otherwise(c)
    wide = lambda n: F.lpad(F.hex(n.cast("long")), 4, "0")
    n = whole(code)
    plain = F.decode(F.unhex(wide(n)), "UTF-16BE")
    lost = F.lit("\ufffd")
    if following is None:
        return F.when(n.between(0xD800, 0xDFFF) | (n > 65535) | (n < 0), lost).otherwise(plain)
    low = whole(following)
    pair = F.decode(F.unhex(F.concat(wide(n), wide(low))), "UTF-16BE")
    return F.when(n.between(0xD800, 0xDBFF) & low.between(0xDC00, 0xDFFF), pair).when(n.between(0xD800, 0xDFFF) | (n > 65535) | (n < 0), lost).otherwise(plain)


def from_byte(hex_pair: Column, charset: str = "cp1252") -> Column:
    """Character of a byte given as two hex digits, by a 256-entry table made from the codec; undefined bytes give U+FFFD."""
    chars = "".join(bytes([b]).decode(charset, "replace") for b in range(256))
    code = F.conv(hex_pair, 16, 10).cast("int")
    return F.substring(F.lit(chars), code + 1, F.lit(1))


def scan(line: Column, delimiters: str = " \t", quotes: str = "\"'", escape: str = "", collapse: bool = True) -> Column:
    """Fields of a line by a scanner's settings: what parts fields, which quotes hold one together, the character that takes the meaning
    of the next one, and whether runs of delimiters count once.  Quotes and escape characters are not part of the fields."""
    cls = lambda chars: "".join(f"\\x{ord(c):02x}" for c in chars)
    units = [rf"{cls(q)}[^{cls(q)}]*{cls(q)}" for q in quotes]
    if escape:
        units.insert(0, rf"(?:{cls(escape)}.)")
    units.append(f"[^{cls(delimiters + quotes + escape)}]")
    pattern = f"(?:{'|'.join(units)})" + ("+" if collapse else "*")
    if collapse:
        found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    else:  # a field follows the begin of the line and every delimiter
        found = F.regexp_extract_all(line, F.lit(f"(?:^|[{cls(delimiters)}])({pattern})"), F.lit(1))
    held = "|".join(f"{cls(q)}([^{cls(q)}]*){cls(q)}" for q in quotes)
    inner = "".join(f"${k + 1}" for k in range(len(quotes)))
    bare = lambda f: F.regexp_replace(f, held, inner) if quotes else f
    if not escape:
        return F.transform(found, bare)
    mark = chr(0xE000)
    hidden = lambda f: F.regexp_replace(f, f"{cls(escape)}(.)", mark + "$1")
    spared = "|".join(f"(?<!{mark}){cls(q)}((?:[^{cls(q)}]|(?<={mark}){cls(q)})*)(?<!{mark}){cls(q)}" for q in quotes)
    return F.transform(found, lambda f: F.replace(F.regexp_replace(hidden(f), spared, inner) if quotes else hidden(f), F.lit(mark), F.lit("")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def join_strings(a: Column, b: Column) -> Column:
    """Concatenation in which a null counts as empty."""
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    """rtf, rtfd, eqn, raw_eqn or unknown, by the extension in any case."""
    ext = extension(path)
    out = F.lit("unknown")
    for e, kind in KINDS.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def output_name(path: Column, folder_for_each: bool = False) -> Column:
    """Where a document's LaTeX goes: beside it as ``.tex``, or in a folder of its own (always for bundles)."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    own = F.concat(stem, F.lit("-latex/"), basename(stem), F.lit(".tex"))
    beside = F.concat(stem, F.lit(".tex"))
    return own if folder_for_each else F.when(extension(path) == "rtfd", own).otherwise(beside)


def inches_to_twips(inches: Column) -> Column:
    return F.round(inches * TWIPS_PER_INCH).cast("int")


def high_nibble(byte: Column) -> Column:
    return F.shiftright(byte, 4).bitwiseAND(F.lit(15))


def low_nibble(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(15))


def unescape(text: Column) -> Column:
    """``\\n``, ``\\r`` and ``\\x`` (any other character) without their backslash."""
    kept = F.replace(text, F.lit("\\\\"), F.lit(chr(0xE000)))
    kept = F.replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(F.regexp_replace(kept, r"\\(.)", "$1"), F.lit(chr(0xE000)), F.lit("\\"))


def scan_fields(line: Column) -> Column:
    """Fields of a line: blanks and tabs separate, runs count once, quotes hold a field together."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"""("[^"]*"|'[^']*'|[^ \t"']+)+"""), F.lit(0)), lambda f: F.regexp_replace(f, "\"([^\"]*)\"|'([^']*)'", "$1$2"))


def scan_all_fields(line: Column) -> Column:
    """Fields of a line where every blank or tab separates, so that empty fields show."""
    return F.split(line, "[ \t]", -1)
