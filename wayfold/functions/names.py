"""Names, region keys and hierarchical zone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from a name before comparing, and the trailing numerals dropped after them.
ADD_ON_WORDS = r"\b(entrance|extention|extension|annex|main|campus)\b"
TRAILING_NUMERAL = r"\s(i{1,3}|iv|v|[0-9]+)$"

# Two-letter transliterations, then one-to-one ones.
TRANSLITERATE_WIDE = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"))
TRANSLITERATE_FROM = "éèêëÉÈÊËáàâãÁÀÂÃíìîïÍÌÎÏóòôõÓÒÔÕúùûÚÙÛçÇñÑ"
TRANSLITERATE_TO = "eeeeEEEEaaaaAAAAiiiiIIIIooooOOOOuuuUUUcCnN"


def name_base(name: Column) -> Column:
    """Comparison key of a place name: no add-on words, no trailing numeral, first three words."""
    text = F.lower(F.coalesce(name, F.lit("")))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, ADD_ON_WORDS, ""), TRAILING_NUMERAL, ""))
    return F.array_join(F.slice(F.split(text, " "), 1, 3), " ")


# What is cut from region names, cities and file names, and the name of a region without one.
LINE_BREAK = r"(?i)<br\s*/?>"
COUNTRY_PREFIX = r"^[a-z]{2,3}/"
NO_REGION_NAME = "unbekannter_name"
NO_PLACE_NAME = "unknown_place"


def title_case(text: Column) -> Column:
    """Every letter that follows a non-letter in upper case, all others in lower case."""
    mark = "\u0001 "
    parted = F.regexp_replace(F.lower(text), r"(?<=[^\p{L}\s])(?=\p{L})", mark)
    return F.replace(F.initcap(parted), F.lit(mark), F.lit(""))


def clean_region_name(name: Column) -> Column:
    """Readable region name: no line-break markup, no country prefix, no punctuation, title case."""
    text = F.regexp_replace(name, LINE_BREAK, " ")
    text = F.regexp_replace(text, COUNTRY_PREFIX, "")
    text = F.regexp_replace(F.regexp_replace(text, "-", " "), r"[^\p{L}\p{N}_\s]", " ")
    text = F.trim(F.regexp_replace(title_case(text), r"\s+", " "))
    return F.coalesce(text, F.lit(NO_REGION_NAME))


def clean_city(address: Column) -> Column:
    """File-name form of the first address part; a fixed name where there is no address."""
    text = F.split(address, ",")[0]
    for wide, narrow in TRANSLITERATE_WIDE:
        text = F.replace(text, F.lit(wide), F.lit(narrow))
    text = F.translate(text, TRANSLITERATE_FROM, TRANSLITERATE_TO)
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", ""))
    return F.coalesce(F.regexp_replace(text, r"[-\s]+", "_"), F.lit(NO_PLACE_NAME))


def extract_key(filename: Column) -> Column:
    """Extract file name without extension, date prefix and version suffixes."""
    text = F.regexp_replace(F.lower(filename), r"\.osm\.pbf$", "")
    text = F.regexp_replace(text, r"^\d{4}-\d{2}-\d{2}_", "")
    return F.regexp_replace(text, r"(-(latest|\d{6}|\d{8}))+$", "")


def compact_key(filename: Column) -> Column:
    """Loose form used to match outline files to extracts: base name only, no separators."""
    text = F.element_at(F.split(F.replace(F.lower(filename), F.lit("\\"), F.lit("/")), "/"), -1)
    text = F.regexp_replace(text, r"^\d{4}-\d{2}-\d{2}_", "")
    text = F.regexp_replace(text, r"-(latest|\d{6})\.osm\.pbf$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\.osm\.pbf$", ""), r"\.pbf$", "")
    return F.translate(text, "-_ ", "")


def gid_part(gid: Column, level: int) -> Column:
    """The `level`-th part of a dotted identifier without its `_n` suffix (level 0 is the country)."""
    return F.regexp_replace(F.get(F.split(gid, r"\."), F.lit(level)), "_.*", "")


def _padded(gid: Column, depth: int) -> list[Column]:
    return [F.lpad(gid_part(gid, level), 3, "0") for level in range(1, depth + 1)]


def normalize_gid(gid: Column, depth: int) -> Column:
    """Country code followed by each level padded to three digits."""
    return F.concat(gid_part(gid, 0), *_padded(gid, depth))


def requested_countries(iso_list: str) -> list[str]:
    """The first eight codes of a comma-separated list."""
    return iso_list.replace(" ", "").split(",")[:8]


def zone_no(gid: Column, iso_list: str, depth: int) -> Column:
    """Country position in the list plus two, followed by the padded levels."""
    codes = F.array(*[F.lit(code) for code in requested_countries(iso_list)])
    position = (F.array_position(codes, gid_part(gid, 0)) + 1).cast("string")
    return F.concat(position, *_padded(gid, depth))
