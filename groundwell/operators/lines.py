"""Line chunking (C01-C05, C18): one row per document in, one row per chunk out, without a shuffle.

A document is one cell, so its lines are handled as an array inside the row. Headings cut that array into sections;
each section is a slice, which keeps the work linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import first_reason, is_blank, join_titles, let, trim
from groundwell.functions.tokens import pieces_needed

MAX_CHARS = 120
OVERLAP_CHARS = 20

# Prefixes that make a short line a section heading.
HEADING_PREFIXES = ("一、", "二、", "三、", "四、", "五、", "1.", "2.", "3.")
HEADING_MAX_CHARS = 18
HEADING_COLONS = ":："


def heading_of(line: Column) -> Column:
    """C02 for a trimmed line: the heading text, possibly empty, or null when the line is not a heading."""
    marked = trim(F.ltrim(line, F.lit("#")))
    prefixed = F.lit(False)
    for prefix in HEADING_PREFIXES:
        prefixed = prefixed | F.startswith(line, F.lit(prefix))
    colon = line.rlike(f"[{HEADING_COLONS}]\\z")
    short = (F.char_length(line) <= HEADING_MAX_CHARS) & prefixed
    return F.when(F.startswith(line, F.lit("#")), F.nullif(marked, F.lit(""))).when(
        colon | short, F.rtrim(line, F.lit(HEADING_COLONS))
    )


def windows_of(line: Column, size: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Overlapping character windows; the last one is the first that reaches the end of the line."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    starts = F.sequence(F.lit(0), pieces_needed(F.char_length(line), size, overlap) - 1)
    pieces = F.transform(starts, lambda i: trim(F.substring(line, i * step + 1, F.lit(size))))
    return F.when(F.char_length(line) <= size, F.array(line)).otherwise(pieces)


def _sections(marked: Column) -> Column:
    """Slices of the marked lines, each with the heading in force.

    A heading takes effect only when it is not empty and the very next line is not a heading too.
    """
    last = F.size(marked) - 1

    def takes_effect(i: Column) -> Column:
        here = F.get(marked, i)["heading"]
        next_is_heading = F.get(marked, i + 1)["heading"].isNotNull()
        return F.coalesce(here, F.lit("")).__ne__("") & ~F.coalesce(next_is_heading, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), last), takes_effect)
    # The text before the first heading is a section of its own that starts at -1.
    starts = F.concat(F.array(F.lit(-1)), starts)

    def cut(bounds: Column) -> Column:
        def section(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(bounds, j + 1), last + 1)
            title = F.when(start < 0, F.lit("")).otherwise(F.get(marked, F.greatest(start, F.lit(0)))["heading"])
            return F.struct(
                title.alias("section"),
                F.slice(marked, start + 2, F.greatest(end - start - 1, F.lit(0))).alias("lines"),
            )

        return F.transform(bounds, section)

    return let(starts, cut)


def _pieces(text: Column, title: Column, size: int, overlap: int) -> Column:
    """All chunks of one document as an array of (title, text)."""
    lines = F.transform(F.split(text, "\n"), trim)
    marked = let(
        lines, lambda rows: F.transform(rows, lambda l: F.struct(l.alias("line"), heading_of(l).alias("heading")))
    )

    def section_pieces(section: Column) -> Column:
        body = F.filter(section["lines"], lambda l: l["heading"].isNull() & (l["line"] != ""))
        parts = F.flatten(F.transform(body, lambda l: windows_of(l["line"], size, overlap)))
        return F.transform(parts, lambda p: F.struct(join_titles(title, section["section"]).alias("title"),
                                                     p.alias("text")))

    def or_whole(pieces: Column) -> Column:
        whole = F.array(F.struct(title.alias("title"), trim(text).alias("text")))
        return F.when(F.size(pieces) == 0, whole).otherwise(pieces)

    return let(F.flatten(F.transform(let(marked, _sections), section_pieces)), or_whole)


def document_reason() -> Column:
    return first_reason(
        (is_blank(F.col("document_id")), "document_id_required"),
        (is_blank(F.col("text")), "text_required"),
    )


def line_chunks(documents: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of every valid document.

    ``documents`` has document_id, title, source_ref, text and tags.
    """
    valid = documents.filter(document_reason().isNull())
    return valid.select(
        "document_id", "source_ref", "tags",
        F.posexplode(_pieces(F.col("text"), F.coalesce("title", F.lit("")), size, overlap)).alias("chunk_index", "c"),
    ).select(
        "document_id",
        F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("c.title").alias("title"),
        "source_ref",
        F.col("c.text").alias("text"),
        "tags",
    )


def rejected_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("reject_reason", document_reason()).filter(F.col("reject_reason").isNotNull())


def split_preview(documents: DataFrame) -> DataFrame:
    """The chunks a document would give, without storing them."""
    return line_chunks(documents).select("document_id", "chunk_id", "chunk_index", "text")


def line_headings(documents: DataFrame) -> DataFrame:
    """C02 as a relation: every line of every document with its heading text, null for ordinary lines."""
    lines = documents.select("document_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.withColumn("line", trim(F.col("raw"))).select(
        "document_id", F.col("line_no").cast("long").alias("line_no"), "line", heading_of(F.col("line")).alias("heading")
    )
