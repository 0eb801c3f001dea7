"""Token sets for lexical search and pluggable token counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import let


def token_set(value: Column) -> Column:
    """ASCII words, single CJK characters and CJK bigrams as one distinct array. White space is no part of a token, so the
    search form of the text is not needed, only its lower case."""

    def tokens(text: Column) -> Column:
        words = F.array_remove(F.split(text, "[^a-z0-9]+"), "")
        cjk = F.regexp_replace(text, "[^\\u4e00-\\u9fff]+", "")

        def with_cjk(run: Column) -> Column:
            single = F.filter(F.split(run, ""), lambda c: c != "")
            pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
            pairs = F.when(F.length(run) > 1, pairs).otherwise(F.array().cast("array<string>"))
            return F.when(run == "", words).otherwise(F.concat(words, single, pairs))

        # A text of one byte a character holds no CJK.
        plain = F.octet_length(text) == F.char_length(text)
        return F.array_distinct(F.when(plain, words).otherwise(let(cjk, with_cjk)))

    return let(F.lower(value), tokens)


def similarity(left: Column, right: Column) -> Column:
    """J03 over two token arrays: shared / sqrt(|left| * |right|), zero when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    sizes = (F.size(left) * F.size(right)).cast("double")
    return F.when(sizes == 0, F.lit(0.0)).otherwise(shared / F.sqrt(sizes))


@dataclass(frozen=True)
class TokenCounter:
    """A counter is a column expression; ``python`` is needed only where texts are split to fit.

    ``additive`` states that the count of a concatenation is the sum of the counts, which lets the splitter use
    closed forms instead of trying prefixes. ``longest`` states that no token has more characters, so that the splitter
    tries no text that cannot fit. ``cut`` is a pattern of places, without width, that no token crosses whatever stands
    around them, so that a long text may be counted in parts.
    """

    column: Callable[[Column], Column]
    python: Callable[[str], int] | None = None
    additive: bool = False
    longest: int | None = None
    cut: str | None = None

    def __call__(self, text: Column) -> Column:
        return self.column(text)

    def guarded(self, text: Column) -> Column:
        """C17: a negative count, or zero for a non-empty text, is an error."""
        count = self.column(text)
        bad = (count < 0) | ((text != "") & (count == 0))
        return F.when(bad, F.raise_error(F.lit("token counter broke its contract")).cast("long")).otherwise(count)


CODE_POINTS = TokenCounter(column=lambda text: F.char_length(text).cast("long"), python=len, additive=True)


def python_counter(count: Callable[[str], int], longest: int | None = None, cut: str | None = None) -> TokenCounter:
    """Wrap a Python tokenizer; Spark sends Arrow batches of texts to it."""

    @F.pandas_udf("long")
    def batched(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda text: None if text is None else count(text)).astype("Int64")

    return TokenCounter(column=lambda text: batched(text), python=count, longest=longest, cut=cut)


def pieces_needed(length: Column, size: int, overlap: int) -> Column:
    """How many windows of ``size`` with ``overlap`` cover ``length`` characters."""
    step = size - overlap
    return F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step).cast("int") + 1)
