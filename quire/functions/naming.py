"""Names of outputs, and the lenient reading of typed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(name: Column) -> Column:
    """name without its first ".pdf", wherever that is; case counts."""
    return F.regexp_replace(name, r"(?s)\A(.*?)\.pdf", "$1")


def page_name(name: Column, page_number: Column) -> Column:
    return F.concat(base_name(name), F.lit("_page_"), page_number.cast("string"), F.lit(".png"))


def extract_name(name: Column, first: Column, last: Column) -> Column:
    """first and last count from 1."""
    return F.concat(base_name(name), F.lit("_pages_"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(".pdf"))


def edited_name(name: Column) -> Column:
    return F.concat(base_name(name), F.lit("_edited.pdf"))


def merged_name(set_id: Column) -> Column:
    """One key a set, so that outputs of many sets don't collide."""
    return F.concat(F.lit("merged/"), set_id.cast("string"))


def images_name(set_id: Column) -> Column:
    return F.concat(F.lit("images_to_pdf/"), set_id.cast("string"))


#: Sign, hexadecimal digits, decimal digits. White space is that of scripts in a browser: of ASCII, of Unicode, and the byte order mark.
_NUMBER = r"\A[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]*([+-]?)(?:0[xX]([0-9a-fA-F]+)|(?!0[xX])(\d+))"


def parse_int(text: Column) -> Column:
    """The whole number that a text begins with, after white space of Unicode; null if there is none or it doesn't fit an int.

    0x or 0X begins a hexadecimal number.
    """
    found = lambda group: F.regexp_extract(text, _NUMBER, group)
    hexadecimal, decimal = found(2), found(3)
    # up to 8 digits, beyond which a number fits no int
    value = F.when(hexadecimal.rlike("^0*[0-9a-fA-F]{1,8}$"), F.conv(F.right(hexadecimal, F.lit(8)), 16, 10)).when(hexadecimal == "", F.when(decimal != "", decimal))
    return F.concat(found(1), value).try_cast("int")
