"""Structured chunking (C06-C19): one row per document in, one row per chunk out, without a shuffle.

The lines of a document are parsed as an array inside its row. Fenced blocks are found by a fold over the fence lines
only; the prose between them is turned into blocks by one split on blank lines, and headings cut the blocks into
sections. Each step hands slices on, so the work follows the size of the text. Only documents that contain a fence, or
all documents when the counter is a Python function, pass through an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import identity as ids
from groundwell.functions.text import compute_once, is_blank, let, portable, trim
from groundwell.functions.tokens import CODE_POINTS, TokenCounter
from groundwell.operators.splitting import FENCED, PARAGRAPH, DoesNotFit, Splitter

ROOT_PATH = "Document"
UNIT_KINDS = ("paragraph", "code", "go_preamble", "go_declaration")
_UNIT = "struct<kind:string,path:string,text:string>"
_UNITS = f"array<{_UNIT}>"
FOLD_BATCH = 256

# Markers in front of a block. A text line that happens to start with one of them gets the escape marker.
_HEADING, _ESCAPE, _CODE = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class ChunkPolicy:
    max_tokens: int
    overlap_lines: int = 0
    parser_version: str = "parser-v1"
    embedding_model: str = "hash-64"

    def __post_init__(self) -> None:
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if self.overlap_lines < 0:
            raise ValueError("overlap_lines must not be negative")
        if 0 < self.max_tokens <= self.overlap_lines:
            raise ValueError("overlap_lines must be smaller than max_tokens")


def _empty(array_type: str) -> Column:
    return F.array().cast(array_type)


# --- documents -----------------------------------------------------------------------------------------------------


def normalize_documents(documents: DataFrame) -> DataFrame:
    """Trimmed identity, normal format, portable content, and the reason a document is refused. No content is empty
    content, so it has a hash as well."""
    return compute_once(
        documents,
        reject_reason=F.coalesce(
            ids.identifier_reason(F.col("knowledge_scope"), "knowledge_scope"),
            ids.identifier_reason(F.col("document_id"), "document_id"),
            ids.source_ref_reason(F.col("source_ref")),
            ids.format_reason(F.col("format")),
            F.when(is_blank(F.col("content")), F.lit("content_required")),
        ),
        knowledge_scope=trim(F.col("knowledge_scope")),
        document_id=trim(F.col("document_id")),
        source_ref=trim(F.col("source_ref")),
        format=ids.normal_format(F.col("format")),
        content=F.coalesce(portable(F.col("content")), F.lit("")),
    )


# --- markdown ------------------------------------------------------------------------------------------------------


def heading_of(line: Column) -> Column:
    """(level, title) of an ATX heading line, null for any other line."""
    marks = F.regexp_extract(line, r"\A {0,3}(#{1,6})[ \t]", 1)

    def parse(hashes: Column) -> Column:
        rest = F.substring(F.ltrim(line, F.lit(" ")), F.length(hashes) + 1, F.length(line))
        title = trim(F.rtrim(trim(rest), F.lit("#")))
        return F.when((hashes != "") & (title != ""), F.struct(F.length(hashes).alias("level"), title.alias("title")))

    return F.when(F.startswith(F.ltrim(line, F.lit(" ")), F.lit("#")), let(marks, parse))


def fence_of(line: Column, i: Column) -> Column:
    """(line, char, run, bare) of a line that may open or close a fence, null for any other line."""
    text = trim(line)
    run = F.length(F.regexp_extract(text, r"\A(`{3,}|~{3,})", 1))
    return F.when(
        F.startswith(text, F.lit("```")) | F.startswith(text, F.lit("~~~")),
        F.struct(i.alias("line"), F.substring(text, 1, 1).alias("char"), run.alias("run"),
                 (run == F.length(text)).alias("bare")),
    )


def fence_blocks(lines: Column) -> Column:
    """(blocks, open) where ``open`` is the line of an unclosed fence or -1."""
    marks = F.filter(F.transform(lines, fence_of), lambda m: m.isNotNull())
    closed = F.struct(F.lit(-1).alias("line"), F.lit("").alias("char"), F.lit(0).alias("run"))

    def step(state: Column, mark: Column) -> Column:
        now = state["open"]
        opened = F.struct(state["done"].alias("done"), F.struct(
            mark["line"].alias("line"), mark["char"].alias("char"), mark["run"].alias("run")).alias("open"))
        block = F.struct(now["line"].alias("first"), mark["line"].alias("last"))
        done = F.struct(F.concat(state["done"], F.array(block)).alias("done"), closed.alias("open"))
        closes = mark["bare"] & (mark["char"] == now["char"]) & (mark["run"] >= now["run"])
        return F.when(now["line"] < 0, opened).when(closes, done).otherwise(state)

    return let(_fold(marks, "array<struct<first:int,last:int>>", closed, step), lambda state: F.struct(
        state["done"].alias("blocks"), state["open"]["line"].alias("open")))


def _prose_line(line: Column) -> Column:
    clash = F.substring(line, 1, 1).isin(_HEADING, _ESCAPE, _CODE)
    plain = F.when(is_blank(line), F.lit("")).when(clash, F.concat(F.lit(_ESCAPE), line)).otherwise(line)

    def mark(heading: Column) -> Column:
        text = F.concat(F.lit("\n\n" + _HEADING), heading["level"].cast("string"), heading["title"], F.lit("\n\n"))
        return F.when(heading.isNull(), plain).otherwise(text)

    return let(heading_of(line), mark)


def _blocks(lines: Column, fences: Column) -> Column:
    """Heading marks, code marks and paragraphs of a document in order."""
    blocks = fences["blocks"]

    def stretch(j: Column) -> Column:
        first = F.when(j == 0, F.lit(0)).otherwise(F.get(blocks, j - 1)["last"] + 1)
        end = F.coalesce(F.get(blocks, j)["first"], F.size(lines))
        prose = F.transform(F.slice(lines, first + 1, F.greatest(end - first, F.lit(0))), _prose_line)
        code = F.array(F.concat(F.lit("\n\n" + _CODE), j.cast("string"), F.lit("\n\n")))
        return F.when(j < F.size(blocks), F.concat(prose, code)).otherwise(prose)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks)), stretch)), "\n")
    return F.filter(F.split(text, "\n{2,}"), lambda b: b != "")


def heading_paths(headings: Column) -> Column:
    """The path of each heading; a title stays in force until a heading of its level or above appears."""
    def step(state: Column, heading: Column) -> Column:
        stack = F.concat(F.filter(state["open"], lambda s: s["level"] < heading["level"]), F.array(heading))
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " / ")
        return F.struct(F.concat(state["done"], F.array(path)).alias("done"), stack.alias("open"))

    return _fold(headings, "array<string>", _empty("array<struct<level:int,title:string>>"), step)["done"]


def _code_text(lines: Column, block: Column) -> Column:
    body = F.slice(lines, block["first"] + 2, block["last"] - block["first"])
    return F.concat(trim(F.get(lines, block["first"])), F.lit("\n"), F.array_join(body, "\n"))


def _unit(block: Column, path: Column, lines: Column, fences: Column) -> Column:
    code = F.get(fences["blocks"], F.substring(block, F.lit(2), F.length(block)).cast("int"))
    text = F.btrim(block, F.lit("\n"))
    plain = F.when(F.contains(text, F.lit(_ESCAPE)), F.regexp_replace(text, rf"(?<=\A|\n){_ESCAPE}", "")).otherwise(text)
    is_code = F.startswith(block, F.lit(_CODE))
    return F.struct(
        F.when(is_code, F.lit(FENCED)).otherwise(F.lit(PARAGRAPH)).alias("kind"),
        path.alias("path"),
        F.when(is_code, _code_text(lines, code)).otherwise(plain).alias("text"),
    )


def _units(lines: Column, fences: Column) -> Column:
    """C10 with C09: units of one document in order."""

    def by_section(blocks: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(blocks) - 1),
            lambda i: F.startswith(F.get(blocks, i), F.lit(_HEADING)),
        )
        heads = F.when(F.size(blocks) > 0, heads).otherwise(_empty("array<int>"))

        def parsed(i: Column) -> Column:
            mark = F.get(blocks, i)
            return F.struct(F.substring(mark, 2, 1).cast("int").alias("level"),
                            F.substring(mark, F.lit(3), F.length(mark)).alias("title"))

        def cut(bounds: Column) -> Column:
            paths = heading_paths(F.transform(F.slice(bounds, F.lit(2), F.size(bounds)), parsed))

            def section(start: Column, j: Column, known: Column) -> Column:
                end = F.coalesce(F.get(bounds, j + 1), F.size(blocks))
                path = F.when(j == 0, F.lit(ROOT_PATH)).otherwise(F.get(known, j - 1))
                body = F.slice(blocks, start + 2, F.greatest(end - start - 1, F.lit(0)))
                return F.transform(body, lambda b: _unit(b, path, lines, fences))

            return let(paths, lambda known: F.flatten(F.transform(bounds, lambda s, j: section(s, j, known))))

        return let(F.concat(F.array(F.lit(-1)), heads), cut)

    return let(_blocks(lines, fences), by_section)


def parse_markdown(documents: DataFrame) -> DataFrame:
    """Adds ``units`` and refuses documents with an unclosed fence."""
    staged = compute_once(documents, _lines=F.when(F.col("reject_reason").isNull(), F.split("content", "\n")))
    staged = compute_once(staged, _fences=fence_blocks(F.col("_lines")))
    closed = F.col("_fences.open") < 0
    staged = compute_once(
        staged,
        units=F.when(closed, _units(F.col("_lines"), F.col("_fences"))),
        reject_reason=F.coalesce("reject_reason", F.when(~closed, F.lit("unclosed_fence"))),
    )
    return staged.drop("_lines", "_fences")


def markdown_units(documents: DataFrame) -> DataFrame:
    """C10 as a relation: one row per unit of every accepted Markdown document."""
    parsed = parse_markdown(normalize_documents(documents))
    return parsed.filter(F.col("reject_reason").isNull()).select(
        "knowledge_scope", "document_id", F.posexplode("units").alias("unit_no", "u")
    ).select(
        "knowledge_scope", "document_id", F.col("unit_no").cast("long").alias("unit_no"),
        F.col("u.kind").alias("structure_kind"), F.col("u.path").alias("heading_path"), F.col("u.text").alias("text"),
    )


# --- splitting and packing with the additive counter ---------------------------------------------------------------


def sentences(text: Column) -> Column:
    """C11: the delimiter stays with its sentence."""
    return F.filter(F.split(text, r"(?<=[.!?。！？\n])"), lambda s: s != "")


def exact_pieces(text: Column, limit: int) -> Column:
    """C13 for the additive counter: the longest fitting prefix is the limit itself."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / limit).cast("int") - 1, F.lit(0)))
    cut = F.transform(starts, lambda i: F.substring(text, i * limit + 1, F.lit(limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def _fold(items: Column, done: str, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold ``items`` into a struct of ``done``, an array that grows, and ``open``.

    Appending copies the array, so each ``FOLD_BATCH`` items fill an array of their own. These are kept as arrays, of which only
    the references are copied, and joined once at the end.
    """
    def folded(all_items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_items) / FOLD_BATCH).cast("int") - 1, F.lit(0))
        batches = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * FOLD_BATCH + 1, F.lit(FOLD_BATCH)))

        def outer(state: Column, batch: Column) -> Column:
            inner = F.aggregate(batch, F.struct(_empty(done).alias("done"), state["open"].alias("open")), step)
            return let(inner, lambda r: F.struct(
                F.concat(state["done"], F.array(r["done"])).alias("done"), r["open"].alias("open")))

        whole = F.aggregate(batches, F.struct(_empty(f"array<{done}>").alias("done"), first.alias("open")), outer)
        return let(whole, lambda r: F.struct(F.flatten(r["done"]).alias("done"), r["open"].alias("open")))

    return let(items, folded)


def packed_sentences(text: Column, limit: int) -> Column:
    """Greedy packing of the sentences of an oversized paragraph. A pack is the longest prefix within the limit that ends
    behind a sentence, or the limit itself inside a longer one, so one scan of the text finds all of them."""
    some = f".{{1,{limit}}}"
    return F.regexp_extract_all(text, F.lit(rf"(?s){some}(?:(?<=[.!?。！？\n])|\z)|{some}"), F.lit(0))


def packed_units(units: Column, limit: int) -> Column:
    """Neighbouring paragraphs under one heading path are joined by a blank line while they fit."""
    def step(state: Column, unit: Column) -> Column:
        last = state["open"]
        fits = F.length(last["text"]) + 2 + F.length(unit["text"]) <= limit
        joins = last.isNotNull() & (last["kind"] == PARAGRAPH) & (unit["kind"] == PARAGRAPH) & (
            last["path"] == unit["path"]) & fits
        merged = F.struct(last["kind"].alias("kind"), last["path"].alias("path"),
                          F.concat(last["text"], F.lit("\n\n"), unit["text"]).alias("text"))
        done = F.when(last.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(last)))
        return F.when(joins, F.struct(state["done"].alias("done"), merged.alias("open"))).otherwise(
            F.struct(done.alias("done"), unit.alias("open")))

    def finish(state: Column) -> Column:
        return F.when(state["open"].isNull(), state["done"]).otherwise(
            F.concat(state["done"], F.array(state["open"])))

    return let(_fold(units, _UNITS, F.lit(None).cast(_UNIT), step), finish)


def _with_text(unit: Column, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(unit["kind"].alias("kind"), unit["path"].alias("path"),
                                                 t.alias("text")))


def _split_paragraphs(units: Column, limit: int) -> Column:
    """C19 where only paragraphs can be too long."""
    return F.flatten(F.transform(units, lambda u: F.when(
        (u["kind"] == PARAGRAPH) & (F.length(u["text"]) > limit), _with_text(u, packed_sentences(u["text"], limit))
    ).otherwise(F.array(u))))


def _code_splitter(policy: ChunkPolicy, counter: TokenCounter):
    """Arrow UDF for C14: the pieces of each oversized code unit, null for units that are not touched and an empty
    list for units that cannot be split."""

    @F.pandas_udf("array<array<string>>")
    def split(batch: pd.Series) -> pd.Series:
        cutter = Splitter(counter.python, policy.max_tokens, policy.overlap_lines, counter.additive, counter.longest)

        def pieces(unit):
            if unit is None:
                return None
            try:
                return cutter.code(unit["text"], unit["kind"] == FENCED)
            except DoesNotFit:
                return []

        return batch.map(lambda units: None if units is None else [pieces(u) for u in units])

    # Marked as nondeterministic so that the planner neither repeats the call nor moves it into another expression.
    return split.asNondeterministic()


def _unit_packer(policy: ChunkPolicy, counter: TokenCounter):
    """Arrow UDF for C12-C15 with an opaque counter."""

    @F.pandas_udf(_UNITS)
    def pack(batch: pd.Series) -> pd.Series:
        cutter = Splitter(counter.python, policy.max_tokens, policy.overlap_lines, counter.additive, counter.longest)

        def packed(units):
            try:
                split = [(u["kind"], u["path"], t) for u in units for t in cutter.unit(u["kind"], u["text"])]
            except DoesNotFit:
                return None
            return [dict(kind=k, path=p, text=t) for k, p, t in cutter.pack(split)]

        return batch.map(lambda units: None if units is None else packed(units))

    return pack.asNondeterministic()


def split_units(parsed: DataFrame, policy: ChunkPolicy) -> DataFrame:
    """Adds ``split``, the units with every oversized one cut by its kind; null where one cannot be cut. Counts code points."""
    limit = policy.max_tokens
    # The test for code reads the raw text, so that neither branch parses the documents of the other.
    may_hold_code = F.coalesce(
        (F.col("format") != "markdown") | F.contains("content", F.lit("```")) | F.contains("content", F.lit("~~~")),
        F.lit(False),
    )
    prose = compute_once(parsed.filter(~may_hold_code), split=_split_paragraphs(F.col("units"), limit))
    code = compute_once(parsed.filter(may_hold_code), _oversized=F.transform("units", lambda u: F.when(
        (u["kind"] != PARAGRAPH) & (F.length(u["text"]) > limit), u)))
    code = code.withColumn("_pieces", _code_splitter(policy, CODE_POINTS)(F.col("_oversized")))
    routed = F.flatten(F.zip_with("units", "_pieces", lambda u, p: F.when(p.isNotNull(), _with_text(u, p)).otherwise(
        _split_paragraphs(F.array(u), limit))))
    stuck = F.exists("_pieces", lambda p: F.coalesce(F.size(p) == 0, F.lit(False)))
    return prose.unionByName(compute_once(code, split=F.when(~stuck, routed)).drop("_oversized", "_pieces"))


def split_and_pack(parsed: DataFrame, policy: ChunkPolicy, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Adds ``packed``; a unit that cannot be brought under the limit refuses its document."""
    accepted = F.col("reject_reason").isNull()
    if not (counter.additive and counter is CODE_POINTS):
        if counter.python is None:
            raise ValueError("splitting needs the Python form of this counter")
        packed = parsed.withColumn("packed", _unit_packer(policy, counter)(F.col("units")))
    else:
        packed = compute_once(split_units(parsed, policy), packed=packed_units(F.col("split"), policy.max_tokens)).drop("split")
    return packed.withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(accepted & F.col("packed").isNull(), F.lit("piece_over_limit"))))



# --- assembly ------------------------------------------------------------------------------------------------------


def duplicate_ordinals(keys: Column) -> Column:
    """For each key the number of equal keys before it. Equal keys are neighbours after a sort, where a place less the start
    of its run is that number; documents without repeated chunks skip it."""

    def count(sorted_keys: Column) -> Column:
        n = F.size(sorted_keys)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (
            F.get(sorted_keys, j)["key"] != F.get(sorted_keys, j - 1)["key"]))
        runs = let(starts, lambda at: F.flatten(F.transform(at, lambda s, k: F.sequence(
            F.lit(0), F.coalesce(F.get(at, k + 1), n) - s - 1))))
        placed = F.zip_with(sorted_keys, runs, lambda item, run: F.struct(item["i"].alias("i"), run.alias("n")))
        return F.transform(F.array_sort(placed), lambda x: x["n"])

    def number(ks: Column) -> Column:
        pairs = F.array_sort(F.transform(ks, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.array_repeat(F.lit(0), F.size(ks))).otherwise(
            let(pairs, count))

    return let(keys, number)


def chunk_documents(documents: DataFrame, policy: ChunkPolicy, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Per document the array ``chunks`` or a ``reject_reason``.

    ``documents`` has knowledge_scope, document_id, source_ref, format and content. Source code has no built-in parser:
    its documents bring their units in a column ``units`` of (kind, path, text), otherwise they are refused.
    """
    normal = normalize_documents(documents)
    if "units" in documents.columns:
        brought = normal.filter(F.col("format") == "go").withColumn("reject_reason", F.coalesce(
            "reject_reason",
            F.when(F.col("units").isNull(), F.lit("units_required")),
            F.when(F.exists("units", lambda u: ~u["kind"].isin(*UNIT_KINDS)), F.lit("unit_kind_unsupported")),
        )).withColumn("units", F.transform("units", lambda u: F.struct(
            u["kind"].alias("kind"), u["path"].alias("path"), portable(u["text"]).alias("text"))))
        parsed = parse_markdown(normal.filter(F.coalesce(F.col("format") != "go", F.lit(True))).drop("units")) \
            .unionByName(brought)
    else:
        parsed = parse_markdown(normal.withColumn("reject_reason", F.coalesce(
            "reject_reason", F.when(F.col("format") == "go", F.lit("units_required")))))
    packed = split_and_pack(parsed, policy, counter)
    hashed = compute_once(packed, packed=F.when(F.col("reject_reason").isNull(), F.transform("packed", lambda u: let(
        portable(u["text"]), lambda text: F.struct(
            u["kind"].alias("kind"), u["path"].alias("path"), text.alias("text"), ids.sha256(text).alias("hash"))))))
    judged = compute_once(
        hashed,
        reject_reason=F.coalesce(
            "reject_reason",
            F.when(F.size("packed") == 0, F.lit("no_chunks")),
            F.when(F.exists("packed", lambda u: u["text"] == ""), F.lit("chunk_content_required")),
            F.get(F.filter(F.transform("packed", lambda u: ids.heading_path_reason(u["path"])),
                           lambda r: r.isNotNull()), F.lit(0)),
        ),
        _duplicates=duplicate_ordinals(
            F.transform("packed", lambda u: F.concat_ws("\x00", u["kind"], u["path"], u["hash"]))),
    )
    chunks = F.zip_with("packed", "_duplicates", lambda u, n: F.struct(
        ids.chunk_id(F.col("knowledge_scope"), F.col("document_id"), u["kind"], u["path"], u["hash"], n)
        .alias("chunk_id"),
        u["kind"].alias("structure_kind"), u["path"].alias("heading_path"), u["text"].alias("text"),
        u["hash"].alias("content_hash"), n.cast("long").alias("duplicate_ordinal"),
    ))
    finished = compute_once(judged, chunks=F.when(F.col("reject_reason").isNull(), chunks))
    return finished.drop("packed", "_duplicates", "units")


def explode_chunks(chunked: DataFrame, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Accepted chunks as rows with their ordinal and token count."""
    kept = [c for c in chunked.columns if c not in ("chunks", "reject_reason", "content", "format")]
    rows = chunked.filter(F.col("reject_reason").isNull()).select(
        *kept, F.posexplode("chunks").alias("ordinal", "c"))
    return rows.select(
        *kept, F.col("ordinal").cast("long").alias("ordinal"), "c.*",
    ).withColumn("token_count", counter.guarded(F.col("text")))


def structured_chunks(documents: DataFrame, policy: ChunkPolicy, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Documents to chunk rows."""
    return explode_chunks(chunk_documents(documents, policy, counter), counter)


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, kept and removed chunk ids between two versions."""
    left = before.select("chunk_id", F.lit(True).alias("_before"))
    right = after.select("chunk_id", F.lit(True).alias("_after"))
    return left.join(right, "chunk_id", "full").select(
        "chunk_id",
        F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("kept")
        .alias("change"),
    )
