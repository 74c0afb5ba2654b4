"""Palette files: .hex (one #rrggbb a line) and .gpl. They are short lists for the driver."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.files import write_bytes

Colour = tuple[int, int, int]
PROGRAM = "gridloom"


def parse_hex(text: str) -> list[Colour]:
    """The first word of each line; words that start with # but are no colour are comments."""
    found = []
    for line in text.splitlines():
        word = (line.split() or [""])[0]
        if not word:
            continue
        if not word.startswith("#"):
            raise ValueError(f"not a colour: {word!r}")
        if len(word) != 7:
            continue
        if not re.fullmatch("#[0-9a-fA-F]{6}", word):
            raise ValueError(f"not a colour: {word!r}")
        found.append(tuple(int(word[i : i + 2], 16) for i in (1, 3, 5)))
    if not found:
        raise ValueError("the palette has no colours")
    return found


def parse_gpl(text: str) -> list[Colour]:
    found = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "GIMP Palette", "Name:", "Columns:")):
            continue
        words = line.split()
        if len(words) < 3 or not all(re.fullmatch("[0-9]{1,3}", w) and int(w) < 256 for w in words[:3]):
            raise ValueError(f"not a colour: {line!r}")
        found.append(tuple(int(w) for w in words[:3]))
    if not found:
        raise ValueError("the palette has no colours")
    return found


def format_hex(colours: list[Colour]) -> str:
    return "".join(f"#{r:02x}{g:02x}{b:02x}\n" for r, g, b in colours)


def format_gpl(colours: list[Colour], name: str = "") -> str:
    lines = [f"{r:3d} {g:3d} {b:3d}\t#{r:02x}{g:02x}{b:02x}\n" for r, g, b in colours]
    return f"GIMP Palette\nName: {name or PROGRAM}\nColumns: 8\n#\n" + "".join(lines)


READERS, WRITERS = {"hex": parse_hex, "gpl": parse_gpl}, {"hex": format_hex, "gpl": format_gpl}


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_palette(spark: SparkSession, path: str) -> list[Colour]:
    """By the file's extension, which may be in capitals."""
    kind = os.path.splitext(path)[1][1:].lower()
    if kind not in READERS:
        raise ValueError(f"unknown palette format: {path}")
    return READERS[kind](_text(spark, path))


def write_palette(spark: SparkSession, colours: list[Colour], path: str, kind: str = "hex") -> str:
    """The palette's text, written to a path unless that is -."""
    if kind not in WRITERS:
        raise ValueError(f"unknown palette format: {kind}")
    text = WRITERS[kind](colours)
    if path != "-":
        write_bytes(spark, path, text.encode())
    return text


def palette_table(spark: SparkSession, colours: list[Colour]) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colours)], "ord int, r int, g int, b int")
