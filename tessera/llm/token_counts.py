"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved by encoding each of them once. A text is normalised and
split into pre-tokens here; those that are such strings count one, and only the rest goes through the library's merges.

This holds for texts of proved characters: a character is proved if normalising and splitting it between letters gives
what the library gives. No pre-token, and nothing that normalising looks at, reaches across a blank, tab or line end; so of any
other text only the pieces between these that hold an unproved character go to the library. A text that holds a special token's
string is encoded whole by the library.

A null text counts as empty (0 bytes, 0 tokens). Rows keep their doc_id, null or repeated, one for one; further columns
are left behind. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_characters
from tessera.llm.common import python_pass, slices, texts_of

#: The pre-tokens of the word-end vocabulary after normalisation; a fixed value of its definition.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points for which the library's and this module's treatment are compared.
CANDIDATES = (*range(0x00, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x2045), 0x20AC, 0x2122)
#: What stands between blanks, tabs and line ends.
_BETWEEN = re.compile(r"[^ \t\r\n]+")
CACHED = 300_000
CACHED_CHARS = 48


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(SPLIT).findall
        chars = byte_characters()
        self.bytes_of = {c: b for b, c in enumerate(chars)}
        self.char_of = dict(enumerate(chars))
        safe = [chr(c) for c in CANDIDATES if self._proved(chr(c), chars)]
        self.unproved = re.compile("[^" + "".join(map(re.escape, safe)) + "]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = dict.fromkeys(self._whole(), 1)
        self.known = dict(self.whole)
        self.strange: dict[str, int] = {}

    def _proved(self, c: str, chars: list[str]) -> bool:
        for text in (f"A{c}b", f"1{c}2", f"!{c}?", f"{c}{c}", f" {c} "):
            normal = self.tokenizer.normalizer.normalize_str(text)
            theirs = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if theirs != ["".join(chars[b] for b in p.encode()) for p in self.split(text.lower())]:
                return False
        return True

    def _whole(self) -> list[str]:
        """Vocabulary strings with the word end that the library encodes alone as that one token."""
        found = {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token.endswith("</w>"):
                try:
                    found[bytes(self.bytes_of[c] for c in token[:-4]).decode()] = rank
                except (KeyError, UnicodeDecodeError):
                    pass
        words = list(found)
        return [w for w, e in zip(words, self._encoded(words), strict=True) if e == [found[w]] and self.split(w) == [w]]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[int]:
        merge, to = self.tokenizer.model.tokenize, self.char_of
        return [len(merge(p.encode().decode("latin-1").translate(to))) for p in pieces]

    def _strange(self, pieces: list[str]) -> int:
        """Tokens of pieces that hold unproved characters, as the library counts them."""
        if len(self.strange) > CACHED:
            self.strange = {}
        known = self.strange
        new = [p for p in {*pieces} if p not in known]
        known.update(zip(new, map(len, self._encoded(new)), strict=True))
        total = sum([known[p] for p in pieces])
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return total

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self._encoded([text])[0])
        if not self.unproved(text):
            return self._count(text)
        parts = _BETWEEN.findall(text)
        strange = [p for p in parts if self.unproved(p)]
        return self._strange(strange) + self._count(" ".join([p for p in parts if not self.unproved(p)]))

    def _count(self, text: str) -> int:
        """Tokens of a text of proved characters."""
        pieces = self.split(text.lower())
        if len(self.known) > CACHED + len(self.whole):
            self.known = dict(self.whole)
        known = self.known
        new = [p for p in {*pieces} if p not in known]
        if new:
            known.update(zip(new, self._merged(new), strict=True))
        total = sum([known[p] for p in pieces])
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text exceeds ``limit`` tokens; one narrow pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return python_pass(texts_of(docs), run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
