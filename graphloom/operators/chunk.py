"""Chunks of texts: windows with overlap that end at natural breaks, and packed sentences. Sizes and offsets are UTF-8 bytes of the trimmed text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import byte_slices

# Break patterns in the order they are tried, the bytes before and behind the target where they are looked for, and abbreviations.
BREAKS = (b". ", b".\n", b"! ", b"!\n", b"? ", b"?\n", b"\n\n", b"\n", b" ")
LOOK_BACK, LOOK_AHEAD, LEAST_CHUNK = 100, 50, 50
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "vs.", "etc.", "i.e.", "e.g.", "Fig.", "fig.", "No.", "no.", "Vol.", "vol.", "p.", "pp.", "Inc.", "Ltd.", "Corp.")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)")
CHUNK = "array<struct<index:int,total:int,content:string,start_offset:int,end_offset:int>>"


def limits(size: int, overlap: int, least: int) -> tuple[int, int, int]:
    return max(size, LEAST_CHUNK), min(overlap, size // 2), min(least, size)


def boundary(raw: bytes, at: int) -> int:
    """The character boundary at or before a place."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def break_point(raw: bytes, start: int, target: int, least: int) -> int:
    """The last place behind the first pattern that ends a chunk of more than the least size, in a window about the target; else the target."""
    if target >= len(raw):
        return len(raw)
    low, high = boundary(raw, max(0, target - LOOK_BACK)), boundary(raw, target + LOOK_AHEAD)
    ends = ((at, at + len(p)) for p in BREAKS if (at := raw.rfind(p, low, high)) >= 0)
    return next((end for _, end in ends if end > start + least), boundary(raw, target))


def windows(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> list[tuple[str, int, int]]:
    """(content, start, end) of each chunk. Chunks below the least size are left out unless they reach the end; a chunk may exceed the size by LOOK_AHEAD. Every chunk starts after the one before."""
    size, overlap, least = limits(size, overlap, least)
    text = text.strip()
    raw = text.encode()
    if len(raw) <= size:
        return [(text, 0, len(raw))] if raw else []
    out, start = [], 0
    while start < len(raw):
        end = break_point(raw, start, min(start + size, len(raw)), least)
        if end - start >= least or end >= len(raw):
            out.append((raw[start:end].decode().strip(), start, end))
        if end >= len(raw):
            break
        start = max(boundary(raw, max(0, end - overlap)), boundary(raw, start + 4))
    return out


def is_abbreviation(text: str) -> bool:
    return text.endswith(ABBREVIATIONS) or bool((m := re.search(r"(?:^|\s)(\w)\.$", text.strip())) and m[1].isupper())


def sentences(text: str) -> list[str]:
    """A sentence ends at . ! or ? before white space or the end, unless that closes an abbreviation or a single capital."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if not is_abbreviation(text[at : m.end()]):
            out.append(text[at : m.end()].strip())
            at = m.end()
    return out + [rest] if (rest := text[at:].strip()) else out


def packed_sentences(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> list[tuple[str, int, int]]:
    """Sentences joined by spaces up to the size; the last chunk is kept only from the least size on. Offsets count what was packed, less the overlap."""
    size, overlap, least = limits(size, overlap, least)
    out, held, length, start = [], [], 0, 0
    for s in (x for x in sentences(text.strip()) if x):
        n = len(s.encode())
        if held and length + n + 1 > size:
            out.append((" ".join(held), start, start + length))
            start, held, length = max(0, start + length - overlap), [], 0
        length += n + (1 if held else 0)
        held.append(s)
    if held and length >= least:
        out.append((" ".join(held), start, start + length))
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200, least: int = 100, by_sentence: bool = False) -> DataFrame:
    """A row for each chunk: id, chunk_index, total, content, start_offset, end_offset. Null and empty texts have none."""
    cut = packed_sentences if by_sentence else windows
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    names = ["index", "total", "content", "start_offset", "end_offset"]
    item = pa.struct([(n, pa.string() if n == "content" else pa.int32()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = [cut(x or "", size, overlap, least) for x in part.column("text").to_pylist()]
                rows = [[dict(zip(names, (k, len(c), *x), strict=True)) for k, x in enumerate(c)] for c in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(item))], ["id", "chunks"])

    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, chunks {CHUNK}")
    return out.select(F.col("id").alias(id_col), F.explode("chunks").alias("c")).select(id_col, F.col("c.index").alias("chunk_index"), "c.total", "c.content", "c.start_offset", "c.end_offset")
