"""Batch lexical search (J01-J06, K01): many questions against many chunks in one job.

A pair with score ``shared / sqrt(|question| * |chunk|)`` of at least a floor shares at least ``floor * sqrt(|question| *
|chunk|)`` tokens. So a chunk that holds none of the rarest tokens of a question, all but that many less one, cannot reach the
floor, and one that holds fewer than ``1 + EXTRA`` of the rarest and ``EXTRA`` more cannot either. The index holds these
leading tokens only: each is kept with the largest chunk in which it still matters, so a frequent token, which comes last,
meets small chunks at most or none at all. Matches are counted on numbers in place of tokens, and only pairs with enough of
them are verified on all tokens that the questions ask for.

Floors are scores that the k-th best hit of each question certainly reaches, taken from chunks that hold its rarest tokens
and raised on small parts of all chunks. They only discard pairs that cannot be among the best k, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.text import is_blank, round4, search_text, truncate
from groundwell.functions.tokens import token_set
from groundwell.operators.joins import broadcast_if_small
from groundwell.operators.skew import top_n
from groundwell.operators.stages import materialize

DEFAULT_TOP_K = 5
PREVIEW_CHARS = 120
HIT_ROW_BYTES = 256
#: Floors are raised on one chunk in so many.
FLOOR_PARTS = (32,)
#: The first floors come from the rarest tokens of a question that lie in one chunk in so many together, or in this number.
RARE_PART, RARE_CHUNKS = 256, 2000
#: For each hit of a question, so many chunks with most of its rarest tokens are scored for the first floor.
RARE_TRIES = 4
#: Tokens beyond the leading ones; each asks for one match more.
EXTRA = 3
#: Allowance for rounding in bounds; the exact score decides in the end.
MARGIN = 1e-6


def question_sets(queries: DataFrame) -> DataFrame:
    """The token set of every question that has tokens."""
    return queries.select("query_id", token_set(F.col("question")).alias("tokens")).filter(F.size("tokens") > 0).select(
        "query_id", F.size("tokens").alias("query_size"), F.col("tokens").alias("query_tokens"))


def chunk_token_sets(chunks: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")
    return chunks.select("chunk_id", token_set(text).alias("tokens"))


def _tokens_of(sets: DataFrame) -> DataFrame:
    """``chunk_id, name, chunk_size, token`` of every token of the sets; what :func:`numbered` made are such rows already. Only
    there may two rows of a chunk table share an id, as their numbers differ."""
    if "token" in sets.columns:
        return sets
    return sets.select("chunk_id", F.col("chunk_id").alias("name"), F.size("tokens").alias("chunk_size"),
                       F.explode("tokens").alias("token"))


def _words_of(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", "query_size", F.explode("query_tokens").alias("token"))


def numbered(asked: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with numbers in place of their tokens, and ``chunk_id, name, chunk_size, token`` for every token of a chunk
    that some question asks for. ``chunk_id`` is a number too, and ``name`` the id it stands for."""
    words = _words_of(asked)
    numbers = materialize(words.select("token").distinct().withColumn("_token", F.monotonically_increasing_id()))
    names = _small(numbers)
    asked = words.join(names, "token").groupBy("query_id", "query_size").agg(F.collect_list("_token").alias("query_tokens"))
    chunks = sets.select(F.monotonically_increasing_id().alias("_chunk"), "chunk_id", "tokens")
    rows = chunks.select("_chunk", "chunk_id", F.size("tokens").alias("chunk_size"), F.explode("tokens").alias("token"))
    return materialize(asked), materialize(rows.join(names, "token").select(
        F.col("_chunk").alias("chunk_id"), F.col("chunk_id").alias("name"), "chunk_size", F.col("_token").alias("token")))


def rarest_first(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """``query_id, query_size, place, chunks, token``: the tokens of every question, from the rarest in the chunks to the most
    frequent, and in how many chunks they lie."""
    words = _words_of(asked)
    wanted = _small(words.select("token").distinct())
    frequency = _tokens_of(sets).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("chunks"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), "token")))
    return words.join(frequency, "token", "left").groupBy("query_id", "query_size").agg(order.alias("order")).select(
        "query_id", "query_size", F.posexplode("order").alias("place", "entry")).select(
        "query_id", "query_size", "place", "entry.chunks", "entry.token")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a side of index rows if its measured size allows."""
    return _fits(df)(df)


def _fits(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What broadcasts a side that has no more rows than ``df`` if the measured size of that allows."""
    lengths = df.agg(F.count(F.lit(1)), F.max(F.octet_length(F.col("token").cast("string")))).first()
    return lambda side: broadcast_if_small(side, lengths[0], HIT_ROW_BYTES + (lengths[1] or 0))


def leading_tokens(ordered: DataFrame, floors: DataFrame) -> DataFrame:
    """``token, query_id, query_size, floor, least, reach``: tokens by which a pair is found, for chunks of ``least`` to ``reach`` tokens.

    A question without its first ``place`` tokens has ``query_size - place`` left, which must be fewer than the pair has to
    share; so the token in that place matters while floor * sqrt(query_size * chunk_size) <= query_size - place.
    """
    left = F.least(F.col("query_size") - F.col("place") + EXTRA, F.col("query_size")) + MARGIN
    square = F.col("floor") * F.col("floor") * F.col("query_size")
    found = ordered.join(floors, "query_id").withColumns({"least": F.ceil(square - MARGIN), "reach": F.floor(left * left / square)})
    return found.filter(F.col("reach") >= F.col("least")).select("token", "query_id", "query_size", "floor", "least", "reach")


def proposed_pairs(ordered: DataFrame, held: DataFrame, floors: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` of every pair that can reach the floor of its question, and of some that cannot. Tokens that
    matter in their chunk are brought together by chunk, so that no count of a pair is exchanged."""
    index = materialize(leading_tokens(ordered, floors))
    small = _fits(index)
    spans = small(index.groupBy("token").agg(F.min("least").alias("_least"), F.max("reach").alias("_reach")))
    matter = _tokens_of(held).join(spans, "token").filter(F.col("chunk_size").between(F.col("_least"), F.col("_reach")))
    rows = matter.select("chunk_id", "chunk_size", "token").repartition("chunk_id")
    met = rows.join(small(index), "token").filter(F.col("chunk_size").between(F.col("least"), F.col("reach")))
    counts = met.groupBy("chunk_id", "query_id").agg(
        F.count(F.lit(1)).alias("met"), *[F.first(c).alias(c) for c in ("chunk_size", "query_size", "floor")])
    shared = F.ceil(F.col("floor") * F.sqrt(F.col("query_size").cast("double") * F.col("chunk_size")) - MARGIN)
    return counts.filter(F.col("met") >= F.least(shared, F.lit(1 + EXTRA))).select("query_id", "chunk_id")


def pair_scores(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score, name`` of the given pairs (J03), by their common tokens. ``held`` and ``asked`` are
    :func:`numbered`."""
    words = _small(_words_of(asked))
    pairs = materialize(pairs)
    pairs = broadcast_if_small(pairs, pairs.count(), HIT_ROW_BYTES)
    common = held.join(pairs, "chunk_id").join(words, ["query_id", "token"]).groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("chunk_size", "query_size", "name")])
    score = F.col("shared") / F.sqrt((F.col("query_size") * F.col("chunk_size")).cast("double"))
    return common.select("query_id", "chunk_id", score.alias("score"), "name")


def scores_above(asked: DataFrame, ordered: DataFrame, held: DataFrame, floors: DataFrame) -> DataFrame:
    """Scores of pairs that reach the floor of their question. ``floors`` has query_id and floor."""
    found = pair_scores(proposed_pairs(ordered, held, floors), asked, held)
    return found.join(floors, "query_id").filter(F.col("score") >= F.col("floor")).drop("floor")


def rare_pairs(ordered: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id``: chunks that hold most of the rarest tokens of a question."""
    chunks = held.agg(F.approx_count_distinct("chunk_id")).first()[0]
    so_far = F.sum("chunks").over(Window.partitionBy("query_id").orderBy("place"))
    rare = materialize(ordered.withColumn("_so_far", so_far).filter(
        (F.col("chunks") > 0) & (F.col("_so_far") <= max(RARE_CHUNKS, chunks // RARE_PART))))
    met = held.join(_small(rare.select("token", "query_id")), "token").groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("met"), F.first("chunk_size").alias("chunk_size"))
    return top_n(met, ["query_id"], [F.desc(F.col("met") / F.sqrt("chunk_size")), F.asc("chunk_id")], RARE_TRIES * k).select(
        "query_id", "chunk_id")


def score_floors(asked: DataFrame, ordered: DataFrame, sets: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per question a score that its k-th best chunk certainly reaches, at least the threshold.

    The k-th best chunk of any part of the chunks is not better than the k-th best of all. Each part is searched with the
    floors that the one before gave.
    """
    held = _tokens_of(sets)

    def raised(floors: DataFrame, scores: DataFrame) -> DataFrame:
        best = top_n(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        return materialize(floors.join(kth, "query_id", "left").select("query_id", F.greatest("floor", "_kth").alias("floor")))

    floors = asked.select("query_id", F.lit(threshold).alias("floor"))
    floors = raised(floors, pair_scores(rare_pairs(ordered, held, k), asked, held))
    for parts in FLOOR_PARTS:
        part = held.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == 0)
        floors = raised(floors, scores_above(asked, ordered, part, floors))
    return floors


def best_pairs(queries: DataFrame, chunks: DataFrame, k: int, threshold: float) -> DataFrame:
    """J04 and K01 as (query_id, chunk_id, score, rank); ties go to the smaller chunk id."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive: pairs that share no token are never formed")
    asked, held = numbered(materialize(question_sets(queries)), chunk_token_sets(chunks))
    ordered = materialize(rarest_first(asked, held))
    floors = score_floors(asked, ordered, held, k, threshold)
    scores = scores_above(asked, ordered, held, floors).select("query_id", F.col("name").alias("chunk_id"), "score")
    return top_n(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def search(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_TOP_K, threshold: float = 0.1) -> DataFrame:
    """The best ``k`` chunks per question with their text.

    ``queries`` has query_id and question; ``chunks`` has chunk_id, document_id, title, source_ref and text and should
    be a stored table, as it is read for its tokens and again for the text of the hits.
    """
    pairs = best_pairs(queries, chunks, k, threshold)
    pairs = broadcast_if_small(pairs, queries.count() * k, HIT_ROW_BYTES)
    return chunks.join(pairs, "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_TOP_K, threshold: float = 0.1) -> DataFrame:
    """Hits next to the raw and the normalised question; the normalised one is what is searched."""
    normal = queries.withColumn("normalized_question", search_text(F.col("question")))
    searched = normal.select("query_id", F.col("normalized_question").alias("question"))
    return search(searched, chunks, k, threshold).join(normal, "query_id")


def debug_view(hits: DataFrame, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Score with four decimals and a short preview."""
    return hits.select(
        "query_id", "rank", "document_id", "chunk_id", "title", "source_ref",
        round4(F.col("score")).alias("score"),
        truncate(F.col("text"), preview_chars).alias("preview"),
    )


def content_key(title: Column, text: Column) -> Column:
    return search_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), text))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Of hits with equal normalised title and text the best ranked one stays."""
    keyed = hits.withColumn("_key", content_key(F.col("title"), F.col("text")))
    return top_n(keyed, ["query_id", "_key"], [F.asc("rank")], 1, rank="_copy").drop("_key", "_copy")


def limit_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits per question by rank; zero or less keeps all."""
    return hits if n <= 0 else top_n(hits, ["query_id"], [F.asc("rank")], n, rank="_kept").drop("_kept")


def compress(hits: DataFrame, max_chunks: int, max_chars: int) -> DataFrame:
    """Dedupe, limit, truncate."""
    return limit_hits(dedupe_hits(hits), max_chunks).withColumn("text", truncate(F.col("text"), max_chars))


def _ordered(fields: list[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct("rank", *fields)))


def ids_per_query(hits: DataFrame) -> DataFrame:
    """Chunk ids of an answer in rank order; a question has at most k hits."""
    return hits.groupBy("query_id").agg(
        F.transform(_ordered(["chunk_id"]), lambda h: h["chunk_id"]).alias("chunk_ids")
    )


# The parts of the knowledge prompt and of the answer texts.
PROMPT_SYSTEM = "你是一个离线知识问答助手。优先依据提供的上下文回答；如果上下文不足，请明确说明未命中知识库，不要编造。"
PROMPT_EMPTY = "无命中知识。\n\n"
ANSWER_PREFIX = "根据知识库，"
ANSWER_FALLBACK = "当前未命中知识库，我只能基于通用能力回答："


def knowledge_prompt(queries: DataFrame, hits: DataFrame, max_chars: int) -> DataFrame:
    """System part, numbered knowledge, question; every question gets a prompt."""
    numbered = hits.groupBy("query_id").agg(_ordered(["title", "text"]).alias("_hits"))

    def row(hit: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". ["), F.coalesce(hit["title"], F.lit("")), F.lit("] "),
                        truncate(hit["text"], max_chars), F.lit("\n"))

    knowledge = F.concat(F.array_join(F.transform("_hits", row), ""), F.lit("\n"))
    return queries.join(numbered, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit(f"[System Instruction]\n{PROMPT_SYSTEM}\n\n[Relevant Knowledge]\n"),
            F.when(F.col("_hits").isNull(), F.lit(PROMPT_EMPTY)).otherwise(knowledge),
            F.lit("[User Question]\n"),
            F.col("question"),
        ).alias("prompt"),
    )


def answers(queries: DataFrame, hits: DataFrame, max_chars: int) -> DataFrame:
    """The hit texts as the answer, or the fallback when a question has none."""
    parts = hits.groupBy("query_id").agg(_ordered(["chunk_id", "text"]).alias("_hits"))
    joined = F.array_join(F.transform("_hits", lambda h: truncate(h["text"], max_chars)), " ")
    return queries.join(parts, "query_id", "left").select(
        "query_id",
        "question",
        F.when(F.col("_hits").isNull(), F.concat(F.lit(ANSWER_FALLBACK), F.col("question")))
        .otherwise(F.concat(F.lit(ANSWER_PREFIX), joined)).alias("answer"),
        F.col("_hits").isNotNull().alias("used_knowledge"),
        F.coalesce(F.transform("_hits", lambda h: h["chunk_id"]), F.array().cast("array<string>"))
        .alias("retrieved_chunk_ids"),
    )


def chat_reason() -> Column:
    """The answer request needs a session, a user and a question."""
    return (
        F.when(is_blank(F.col("session_id")), "session_id_required")
        .when(is_blank(F.col("user_id")), "user_id_required")
        .when(is_blank(F.col("question")), "question_required")
    )
