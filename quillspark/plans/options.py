"""Conversion options: bit masks, presets, preference files and their layers."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import inches_to_twips, scan_fields

#: Bits of the four masks.
PARAGRAPH = {"style": 1, "indent": 2, "space": 4, "line_space": 8, "margin": 16, "align": 32}
TEXT = {"size": 1, "color": 2, "form": 4, "no_tab": 8}
TABLE = {"widths": 1, "alignment": 2, "borders": 4}
EQUATION = {"latex": 1, "keep_file": 2, "image": 4, "file_name": 8}
MASKS = {"paragraph": PARAGRAPH, "text": TEXT, "table": TABLE, "equation": EQUATION}
#: Presets.
PRESETS = {"best": {"paragraph": 63, "text": 7, "equation": 1, "table": 3}, "natural": {"paragraph": 33, "text": 12, "equation": 1, "table": 0}}


def has(mask: Column, kind: str, name: str) -> Column:
    """Whether a mask column has the named bit."""
    return mask.bitwiseAND(F.lit(MASKS[kind][name])) != 0


def layered(*choices: Column) -> Column:
    """The first choice that is given: command line, file, default; negative numbers are not given."""
    return F.coalesce(*[F.when(c >= 0, c) for c in choices[:-1]], choices[-1])


@dataclass(frozen=True)
class Options:
    """Settings of a conversion."""

    paragraph: int = 33
    text: int = 7
    equation: int = 1
    table: int = 3
    fragment: bool = False
    own_folder: bool = False
    page_width: float = 8.5
    page_left: float = 1.0
    page_right: float = 1.0
    title_style: str = "title"
    document_class: str = "article"
    pictures: bool = True
    links: bool = True
    page_size: bool = False
    output_map: str = ""
    first_text: str = ""
    second_text: str = ""
    definitions: str = ""
    user_text: str = ""

    def preset(self, name: str) -> Options:
        return replace(self, **PRESETS[name])

    def with_file(self, text: str) -> tuple[Options, list[str]]:
        """Settings of a preference file; unknown names are returned as warnings."""
        out, warnings = self, []
        kinds = {f.name.lower().replace("_", ""): f for f in fields(self)}
        for name, value in preference_lines(text.splitlines()):
            plain = name.lower().replace("_", "")
            if plain in MASK_NAMES:
                mask, bit = MASK_NAMES[plain]
                bits = MASKS[mask][bit]
                now = getattr(out, mask)
                out = replace(out, **{mask: now | bits if value.lower() == "true" else now & ~bits})
            elif (f := kinds.get(PREFERENCES.get(plain, plain).replace("_", ""))) is None:
                warnings.append(name)
            else:
                convert = {"bool": lambda v: v.lower() == "true", "int": int, "float": float}.get(f.type, str)
                out = replace(out, **{f.name: convert(value)})
        if m := re.fullmatch(r"\\documentclass\{(.*)\}", out.document_class):
            out = replace(out, document_class=m[1])
        return out, warnings


#: Names of a preference file that set one bit of a mask, and those that set something else.
MASK_NAMES = {
    "converttextcolor": ("text", "color"), "converttextsize": ("text", "size"), "converttextform": ("text", "form"), "converttextnotab": ("text", "no_tab"),
    "convertparagraphstyle": ("paragraph", "style"), "convertparagraphindent": ("paragraph", "indent"), "convertinterparagraphspace": ("paragraph", "space"),
    "convertlinespacing": ("paragraph", "line_space"), "convertparagraphmargin": ("paragraph", "margin"), "convertparagraphalignment": ("paragraph", "align"),
    "convertequation": ("equation", "latex"), "converttablewidths": ("table", "widths"), "converttablealignment": ("table", "alignment"), "converttableborders": ("table", "borders"),
}
PREFERENCES = {
    "outputmapfilename": "output_map", "pagewidth": "page_width", "pageleft": "page_left", "pageright": "page_right", "convertpagesize": "page_size", "converthypertext": "links",
    "convertpict": "pictures", "convertasdirectory": "own_folder", "preamblefirsttext": "first_text", "preamblesecondtext": "second_text", "preambledocclass": "document_class",
    "converttablename": "title_style",
}
INCHES = ("pagewidth", "pageleft", "pageright")
TEXTS = ("outputmapfilename", "preamblefirsttext", "preamblesecondtext", "preambledocclass", "converttablename")


def preference_lines(lines: list[str]) -> list[tuple[str, str]]:
    """First two fields of every line that is no comment and has two; quotes hold a field together."""
    out = []
    for line in lines:
        found = [re.sub("\"([^\"]*)\"|'([^']*)'", r"\1\2", f) for f in re.findall(r"""(?:"[^"]*"|'[^']*'|[^ \t"'])+""", line)]
        if len(found) > 1 and not found[0].startswith("#"):
            out.append((found[0], found[1]))
    return out


def preferences(lines: Column) -> tuple[Column, Column, Column, Column]:
    """Name, text, number and whether the name is known, of a line of a preference file as columns: page sizes become twips, texts stay,
    anything else is 1 for ``true`` and 0 otherwise; null for comments and lines without two fields."""
    found = scan_fields(lines)
    ok = (F.size(found) > 1) & ~lines.startswith("#")
    name, value = F.when(ok, F.element_at(found, 1)), F.when(ok, F.element_at(found, 2))
    plain = F.lower(name)
    number = F.when(plain.isin(*INCHES), inches_to_twips(value.try_cast("double"))).when(plain.isin(*TEXTS), F.lit(None).cast("int")).otherwise((F.lower(value) == "true").cast("int"))
    return name, F.when(plain.isin(*TEXTS), value), F.when(ok, number), plain.isin(*MASK_NAMES, *PREFERENCES)


def parse_arguments(args: list[str]) -> tuple[dict, list[str]]:
    """Clustered flags, attached or separate values, ``--`` ends the options; the rest are file names."""
    takes, flags = {"p": "paragraph", "t": "text", "e": "equation", "T": "table", "P": "resource_path"}, {"b": "best", "n": "natural", "f": "fragment", "D": "own_folder", "h": "help", "v": "version"}
    out: dict = {}
    rest = list(args)
    while rest and rest[0].startswith("-") and rest[0] != "-":
        word = rest.pop(0)
        if word == "--":
            break
        word = word[1:]
        while word:
            c, word = word[0], word[1:]
            if c in takes:
                value = word or rest.pop(0)
                out[takes[c]] = value if c == "P" else int(value)
                word = ""
            elif c in flags:
                if flags[c] in PRESETS:
                    out |= PRESETS[flags[c]]
                else:
                    out[flags[c]] = True
            else:
                raise ValueError(f"unknown option -{c}")
    return out, rest
