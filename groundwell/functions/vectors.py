"""Vector columns: guards, similarity and the default hashing embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import is_finite, let
from groundwell.functions.tokens import token_set

EMBEDDING_SIZE = 64
_FIRST_BUCKET_CHAR = 48  # bucket b is written as the ASCII character 48 + b


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """Scale to length one in double precision, so a cosine is one dot product; null for a zero vector."""
    return let(norm(vector), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)))


def shape_reason(vector: Column) -> Column:
    """The reason a vector may not be stored."""
    return F.when(vector.isNull() | (F.size(vector) == 0), "empty_vector").when(
        ~F.forall(vector, lambda x: is_finite(x.cast("double"))), "non_finite_vector")


def vector_reason(vector: Column) -> Column:
    """P06 for a search, where a zero vector has no direction to compare."""
    return F.coalesce(shape_reason(vector), F.when(F.forall(vector, lambda x: x == 0), F.lit("zero_vector")))


def hash_embedding(text: Column, size: int = EMBEDDING_SIZE) -> Column:
    """U02 default: token counts in ``size`` MD5 buckets, scaled to length one.

    Each token becomes one character, so a bucket count is a string length difference and the text stays in the JVM.
    """
    if not 0 < size <= EMBEDDING_SIZE:
        raise ValueError(f"size must be between 1 and {EMBEDDING_SIZE}")
    marks = F.transform(
        token_set(text),
        lambda t: F.char(F.conv(F.substring(F.md5(t.cast("binary")), 1, 2), 16, 10).cast("long") % size
                         + _FIRST_BUCKET_CHAR),
    )

    def counts(row: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(_FIRST_BUCKET_CHAR), F.lit(_FIRST_BUCKET_CHAR + size - 1)),
            lambda b: (F.length(row) - F.length(F.replace(row, F.char(b.cast("long")), F.lit("")))).cast("double"),
        )

    return let(
        let(F.array_join(marks, ""), counts),
        lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))),
    )


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """U02 slot: ``load`` runs once per task and returns a batch function from texts to vectors.

    A batch that returns another number of vectors than texts is an integrity failure (P07).
    """

    @F.pandas_udf("array<float>")
    def batched(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for batch in texts:
            vectors = embed(batch.tolist())
            if len(vectors) != len(batch):
                raise ValueError(f"embedding batch returned {len(vectors)} vectors, want {len(batch)}")
            yield pd.Series(vectors)

    return lambda text: batched(text)


def generator(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """U03 slot: ``load`` runs once per task and returns a batch function from prompts to texts."""

    @F.pandas_udf("string")
    def batched(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = load()
        for batch in prompts:
            yield pd.Series(generate(batch.tolist()))

    return lambda prompt: batched(prompt)
