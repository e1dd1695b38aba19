"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and MIME types by file type.
EXTENSIONS = {"text": ("txt", "md", "rst", "text", "markdown"), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "webp", "tiff", "bmp", "gif")}
TEXT_MIMES = ("text/plain", "text/markdown", "text/x-rst")
#: First bytes of image formats.
IMAGE_MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff": "49492A00", "tiff_be": "4D4D002A"}
NO_SNIPPET = "No description available."
PART_BREAK, SOURCE_BREAK = "\n\n", "\n\n---\n\n"


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; after a line end all white space goes; ends are trimmed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+", " "), r"(?U)\n\s*", "\n")
    return F.regexp_replace(flat, r"(?U)^\s+|\s+$", "")


def clean_extracted(text: Column, replacement_too: bool = False) -> Column:
    """squeeze, without control characters; with replacement_too without U+FFFD as well, as for recognised text."""
    out = F.regexp_replace(squeeze(text), r"[\p{Cntrl}&&[^\n\t]]", "")
    return F.regexp_replace(out, "�", "") if replacement_too else out


def file_type(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit("unknown")
    for kind, known in EXTENSIONS.items():
        out = F.when(extension.isin(*known), kind).otherwise(out)
    return out


def mime_type(mime: Column) -> Column:
    return F.when(mime.isin(*TEXT_MIMES), "text").when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").otherwise("unknown")


def sniff_image(content: Column) -> Column:
    """The format that the first bytes show, null if none."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for kind, magic in IMAGE_MAGIC.items():
        out = out.when(head.startswith(magic), kind.removesuffix("_be"))
    return out


def decode_bytes(content: Column) -> Column:
    """Struct of text, encoding and lossy: the encoding follows from the byte order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    encoding = F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").otherwise("utf-8")
    wide = lambda name: F.decode(F.substring(content, F.lit(3), F.length(content)), name)
    utf8 = F.make_valid_utf8(content.cast("string"))
    text = F.when(encoding == "utf-16-le", wide("UTF-16LE")).when(encoding == "utf-16-be", wide("UTF-16BE")).otherwise(F.regexp_replace(utf8, "^﻿", ""))
    return F.struct(text.alias("text"), encoding.alias("encoding"), ((encoding == "utf-8") & ~F.is_valid_utf8(content.cast("string"))).alias("lossy"))


def domain(url: Column) -> Column:
    """The host of a URL, null if there is none."""
    return F.try_parse_url(url, F.lit("HOST"))


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes as %XX but for letters, digits and - . _ ~."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(base: Column, query: Column) -> Column:
    """The address that asks a search service for its first page of results as JSON."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/search?q="), percent_encoded(query), F.lit("&format=json&pageno=1"))


def search_query(content: Column) -> Column:
    """The first ten words of the first hundred characters."""
    words = F.filter(F.split(F.substring(content, 1, 100), r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.slice(words, 1, 10), " ")


def snippet_line(title: Column, url: Column, snippet: Column) -> Column:
    return F.concat(F.lit("• "), title, F.lit(" ("), url, F.lit(")\n"), snippet)


def source_line(rank: Column, source: Column, similarity: Column, content: Column) -> Column:
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit("] (from: "), source, F.lit(", relevance: "), F.format_string("%.1f", similarity * 100), F.lit("%)\n"), content)


def shorten(text: Column, most: int) -> Column:
    """At most so many characters, with dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def ordered_text(order: Column, text: Column, between: str) -> Column:
    """Aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)
