"""Tokens, numbers, file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format names and their mesh form; fixed values.
FORMATS = {"auto": None, "none": None, "obj": "decomposed", "off": "decomposed", "terrain": "decomposed", "json": None, "geojson": None, "xyz": None, "asc": None}
OUTPUTS = ("obj", "off", "terrain", "json", "geojson")


def tokens(text: Column) -> Column:
    """Non-empty parts between blanks, tabs, line ends and NULs."""
    return F.filter(F.split(text, "[ \\n\\r\\t\\x00]+"), lambda x: x != "")


def fixed(v: Column, digits: int = 18) -> Column:
    return F.format_string(f"%.{digits}f", v)


def parse_format(name: Column) -> Column:
    """Lower-cased name without a leading dot; null if unknown."""
    plain = F.regexp_replace(F.lower(name), r"^\.", "")
    return F.when(plain.isin(*FORMATS), plain)


def parsed_format(name: str) -> str | None:
    plain = name.lower().removeprefix(".")
    return plain if plain in FORMATS else None


def output_format(name: str, path: str) -> str:
    """The format to write: `auto` follows the file's extension. Raises for a format that can't be written."""
    found = parsed_format(path.rpartition(".")[2]) if name.lower() == "auto" else parsed_format(name)
    if found not in OUTPUTS:
        raise ValueError(f"no output format: {name} for {path}")
    return found


def strip_home(path: Column, home: str) -> Column:
    return F.when(F.startswith(path, F.lit(home)), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)
