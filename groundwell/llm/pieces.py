"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A text is the merge encoding of itself in pieces p1..pn just when every two neighbours are: merging the characters of
``p[i] p[i+1]`` alone must give these two pieces again. So no merge queue over the text is needed:

1. An Aho-Corasick automaton over the vocabulary finds the longest piece that starts at each character.
2. From the left, the longest piece that may stand behind the one before it is taken; compatibility is decided by re-merging
   the two, and remembered per pair of pieces.
3. Where no piece fits, the position is marked in a bitfield as failed, the last piece is taken back and the next shorter
   prefix is tried there. A prefix of a text has one encoding only, so a failed position never has to be tried again.

Texts are normalized by the library first. Where no piece of the vocabulary holds a word mark behind another character, no
merge crosses that place, and the text is cut there; codes of such words are remembered in a table of a bounded size. The
result does not depend on these cuts.

Defined results: a null or empty text has no ids and decodes to an empty text; characters without a piece become their byte
pieces, or the unknown id in a model without them; invalid bytes are replaced by U+FFFD before; repeated rows are encoded
each; an empty table gives no rows. Other columns pass through in ``row``. Models hold normal, byte, control and
unknown pieces; unused pieces are refused.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import query, table, whole_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of the words, twice, and pairs of pieces, that a worker remembers at once.
WORD_CHARS = 3_000_000
PAIRS = 600_000
#: Longer words are encoded, but not remembered.
LONGEST = 64
MARK = "▁"


class Pieces:
    """Encodes normalized text with the scores of a vocabulary of merges."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor):
        self.processor = processor
        count = processor.get_piece_size()
        kinds = [(processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)) for i in range(count)]
        if any(processor.is_unused(i) for i in range(count)):
            raise ValueError("a model with unused pieces is not supported")
        self.ids = {processor.id_to_piece(i): i for i in range(count) if not kinds[i]}
        self.scores = {piece: processor.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {processor.id_to_piece(i): i for i in range(count) if processor.is_byte(i)}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece in self.ids:
            if len(piece) > 1:
                self.machine.add_word(piece, len(piece))
        self.long = len(self.machine) > 0
        if self.long:
            self.machine.make_automaton()
        self.words = self._word_pattern()
        self.signs = re.compile(rf"[^\w{MARK}]")
        self.beside = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.told = 0
        self.shorter: dict[str, str] = {}
        #: Words seen lately, and those of the time before, from which words that come again are taken over.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}
        self.chars = 0

    def _word_pattern(self) -> re.Pattern:
        """Cuts a text where no merge can cross: before a word mark, and around ASCII characters that no longer piece holds."""
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            return re.compile(r"(?s).+")
        held = set(chain.from_iterable(piece for piece in self.ids if len(piece) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held)
        return re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text: best score first, leftmost of equal ones."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand behind ``left``, or at the start of a text if that is empty."""
        found = self.merged(left + right) == ([left, right] if left else [right])
        if self.told >= PAIRS:
            self.pairs.clear()
            self.told = 0
        self.told += 1
        self.pairs.setdefault(left, {})[right] = found
        return found

    def prefix(self, piece: str) -> str:
        """The next shorter piece that starts this one; at last its first character, then nothing."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), piece[0] if len(piece) > 1 else "")
            self.shorter[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        longest = [1] * len(text)
        if self.long:
            for end, size in self.machine.iter(text):
                longest[end - size + 1] = size
        pairs, nothing, shorter = self.pairs, {}, self.shorter
        failed = None
        taken: list[str] = []
        at, last, size = 0, "", len(text)
        while at < size:
            piece = text[at:at + longest[at]]
            follows = pairs.get(last, nothing)
            while True:
                fit = follows.get(piece)
                if fit is None:
                    fit = self.fits(last, piece)
                if fit and (failed is None or not failed[(at + len(piece)) >> 3] >> ((at + len(piece)) & 7) & 1):
                    taken.append(piece)
                    at, last = at + len(piece), piece
                    break
                piece = shorter[piece] if piece in shorter else self.prefix(piece)
                while not piece:
                    # Nothing fits here: mark the place, take the last piece back and go on with its next shorter prefix.
                    if not taken:
                        raise ValueError("the model does not merge: a text has no encoding")
                    if failed is None:
                        failed = bytearray(size // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = taken.pop()
                    at -= len(piece)
                    last = taken[-1] if taken else ""
                    follows = pairs.get(last, nothing)
                    piece = self.prefix(piece)
        return taken

    def codes(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if not self.bytes:
            return [self.processor.unk_id()]
        return [self.bytes[f"<0x{b:02X}>"] for b in piece.encode()]

    def pack(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit integers; the table holds pieces of the vocabulary only."""
        found = np.array(self.codes(piece), np.int32).tobytes()
        if piece in self.ids:
            self.packed[piece] = found
        return found

    def word(self, word: str) -> bytes:
        if found := self.known.get(word) or self.older.get(word):
            return self.remember(word, found)
        if not word[1:].isalpha() and len(parts := self.parted(word)) > 1:
            known = self.known.get
            return self.remember(word, b"".join([known(part) or self.part(part) for part in parts]))
        return self.part(word)

    def parted(self, word: str) -> list[str]:
        """``word``, cut at signs that no piece holds beside their neighbour."""
        cuts = [i for i in map(re.Match.start, self.signs.finditer(word)) if i and word[i - 1:i + 1] not in self.beside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def part(self, part: str) -> bytes:
        if found := self.known.get(part) or self.older.get(part):
            return self.remember(part, found)
        packed = self.packed.get
        return self.remember(part, b"".join([packed(piece) or self.pack(piece) for piece in self.split(part)]))

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            if self.chars > WORD_CHARS:
                self.older, self.known, self.chars = self.known, {}, 0
            if word not in self.known:
                self.chars += len(word)
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, word = self.known.get, self.word
        parts = [known(w) or word(w) for w in self.words.findall(self.processor.normalize(text))]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist()) if len(ids) else ""


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    """The model in ``model``, read once per worker; the path must name a file that every worker has."""
    return Pieces(sentencepiece.SentencePieceProcessor(model_file=model))


def piece_ids(text: Column, model: str = MODEL) -> Column:
    """Ids of a text column, as array<int>."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        pieces = load(model)
        found = [pieces.encode(t.decode("utf-8", "replace")) if t else np.empty(0, np.int32) for t in texts.to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(ids) for ids in found], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))

    return encode(text.cast("binary"))


def piece_text(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of ids; null ids of a list are left out."""
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        pieces, out = load(model), []
        for part in lists:
            values = part.values
            out.append("" if values is None else pieces.decode(values.drop_null().to_numpy(zero_copy_only=False)))
        return pa.array(out, pa.string())

    return decode(ids)


def encoded(documents: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``row`` (all columns) and ``ids`` of every document."""
    return whole_texts(documents).select(F.struct("*").alias("row"), piece_ids(F.col(text), model).alias("ids"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = encoded(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(piece_text(F.col("ids")), 256).alias("decoded_sha256"))
