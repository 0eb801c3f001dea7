"""License scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for expressions.

Words of the whole text run through one automaton of notice phrases. Behind an ``SPDX-License-Identifier`` tag the rest of
the line is an expression of identifiers, ``AND``, ``OR``, ``WITH`` and parentheses, which is brought into postfix order
and evaluated to a freedom between 0 and 1: ``and`` takes the lesser, ``or`` the greater, an exception halves what is
missing to 1. The score of a text is the least over its notices and expressions; 0.5 where none is found.

Defined results: a null or empty text has no words and no findings; an expression that cannot be parsed contributes the
identifiers in it and no score; repeated rows are scanned one by one; an empty table gives no rows. Other columns pass
through in ``row``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.automaton import Phrases, words_of
from groundwell.llm.common import query, table, whole_texts

#: The phrases that always count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices and the tag.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc", "eclipse public license": "epl",
    "creative commons attribution": "cc-by", "released into the public domain": "public-domain",
    "boost software license": "boost", "all rights reserved": "proprietary", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
TAG = ("spdx license identifier", "tag")
#: How freely text under a label may be used.
FREEDOM = {
    "gpl": 0.4, "agpl": 0.2, "lgpl": 0.6, "mpl": 0.7, "epl": 0.7, "apache": 0.9, "mit": 1.0, "bsd": 1.0, "isc": 1.0,
    "boost": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nc": 0.2, "cc-by-nd": 0.1, "public-domain": 1.0, "proprietary": 0.0,
}
UNKNOWN = 0.5
_TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:[ \t]*([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])
_TYPE = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,"
         "labels:array<string>,score:double>")


def label_of(identifier: str) -> str:
    """The label of an identifier: the longest known name that it starts with, else itself."""
    name = identifier.lower().rstrip("+")
    known = [x for x in FREEDOM if name == x or name.startswith(f"{x}-")]
    return max(known, key=len) if known else name


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard. None if the expression is not well formed."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression):
        strength = _STRENGTH.get(token.lower())
        if strength:
            if operand:
                return None
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= strength:
                out.append(stack.pop())
            stack.append(token.lower())
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(f"id:{token}")
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """Labels of an expression, and its freedom if it can be parsed."""
    order = postfix(expression)
    if order is None:
        names = [t for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _STRENGTH]
        return {x for x in map(label_of, names) if x in FREEDOM}, None
    labels, stack = set(), []
    for token in order:
        if token.startswith("id:"):
            stack.append((FREEDOM.get(label_of(token[3:]), UNKNOWN), {label_of(token[3:])}))
            continue
        (right, second), (left, first) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((left + 1) / 2, first))
        else:
            stack.append(((min if token == "and" else max)(left, right), first | second))
    freedom, labels = stack.pop()
    return labels, freedom


def phrases() -> Phrases:
    entries = [(p, ("base", x)) for p, x in BASE.items()] + [(p, ("notice", x)) for p, x in NOTICES.items()] + [TAG]
    return Phrases({tuple(p.encode().split()): v for p, v in entries})


def scan(text: bytes | None, machine: Phrases) -> dict:
    words = words_of(text)
    starts, base, labels, scores, tagged = [], set(), set(), [], False
    for start, _, value in machine.places(words):
        if value == "tag":
            tagged = True
            continue
        kind, label = value
        labels.add(label)
        scores.append(FREEDOM[label])
        if kind == "base":
            starts.append(start)
            base.add(label)
    for expression in _TAG.findall(text.decode("utf-8", "replace")) if tagged else ():
        found, freedom = evaluate(expression)
        labels |= found
        scores += [] if freedom is None else [freedom]
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": sorted(base), "labels": sorted(labels),
            "score": min(scores, default=UNKNOWN)}


def scan_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns) and ``found``: word counts, places, labels and score."""
    machine = phrases()

    @F.arrow_udf(_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t, machine) for t in texts.to_pylist()], _ARROW)

    return whole_texts(documents).select(F.struct("*").alias("row"), found(F.col(text).cast("binary")).alias("found"))


@query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    scanned = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select(
        "row.doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word",
        F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join("found.labels", ",").alias("labels"),
        "found.score")
