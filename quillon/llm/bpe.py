"""Byte-pair encoding by forced-boundary splitting.

A merge only ever builds vocabulary tokens, so a byte pair that stands inside no vocabulary token
can never end up inside one: between its two bytes lies a certain cut. Words are cut at all such
pairs, each fragment is encoded on its own and the ids are concatenated. Fragments and whole words
recur, so both are cached in every Python worker, in caches of a fixed size.

The tokenizer is a JSON file: lower-casing word vocabulary with an end-of-word suffix, byte-level
symbols, NFC, and special tokens that are matched in the raw text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from quillon.llm.common import text_batches
from quillon.session import table

#: White space as the tokenizer's patterns see it.
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Entries of a worker's young cache; when it is full, it becomes the old one and the old one goes.
CACHE = 120_000
#: Fragments of more symbols are merged with a heap.
LONG = 100


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def char_class(pattern: str, limit: int) -> str:
    """The code points below ``limit`` that ``pattern`` matches by the tokenizer library's own Unicode tables, as ranges
    of a regular expression's class; Python's tables are of another Unicode version."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    found: list[int] = []
    for start in range(0, limit, 128):
        text = "".join(map(chr, (c for c in range(start, start + 128) if not 0xD800 <= c < 0xE000)))
        found += (ord(c) for piece, _ in split.pre_tokenize_str(text) for c in piece) if text else ()
    ranges: list[list[int]] = []
    for c in found:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.merged = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.inside = {a + b for t in self.vocab for s in (t.removesuffix(self.end),) for a, b in zip(s, s[1:], strict=False)}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        # Python's patterns are fast on classes within the basic plane only: one pattern for each range of texts.
        self.words_in = {limit: self.pattern(limit) for limit in (0x80, 0x10000, 0x110000)}
        self.newer = re.compile("[" + "".join(map(chr, (c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cn"))) + "]").search
        self.by_library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.fragments: list[dict[tuple[str, bool], list[int]]] = [{}, {}]
        self.words: list[dict[str, tuple[bytes, str]]] = [{}, {}]

    @staticmethod
    def pattern(limit: int):
        """findall of the words of a text whose code points are below ``limit``."""
        letter, digit = char_class(r"\p{L}", limit), char_class(r"\p{N}", limit)
        space = "".join(c for c in SPACE if ord(c) < limit)
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall

    def fragment(self, text: str, last: bool) -> list[int]:
        """Ids of one fragment: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        parts, rank_of, none = list(text), self.merged.get, 1 << 30
        if last:
            parts[-1] += self.end
        if len(parts) > LONG:
            return self.long_fragment(parts)
        ranks = [rank_of(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def long_fragment(self, parts: list[str]) -> list[int]:
        """The same merges for long fragments, in n log n: a heap of ranked pairs over linked neighbours. A pair that an
        earlier merge has changed is known by its rank, which is no longer that of the symbols at its place."""
        rank_of, n = self.merged.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or rank_of((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.vocab[p] for p in parts if p in self.vocab]

    def cuts(self, symbols: str) -> list[str]:
        """The fragments between forced boundaries."""
        out, start = [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in self.inside:
                out.append(symbols[start:i])
                start = i
        return [*out, symbols[start:]]

    @staticmethod
    def keep(caches: list[dict], key, value):
        """Puts an entry into the young cache of a pair, unless it is long: then a cache's size has a bound in bytes too."""
        if len(value[0] if isinstance(value, tuple) else value) > 4 * LONG:
            return value
        if len(caches[0]) >= CACHE:
            caches[:] = [{}, caches[0]]
        caches[0][key] = value
        return value

    def word(self, word: str) -> tuple[bytes, str]:
        """A word's ids, packed, and its decoded tokens, space-joined."""
        if got := self.words[1].get(word):
            return self.keep(self.words, word, got)
        pieces = self.cuts(word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
        ids: list[int] = []
        for i, piece in enumerate(pieces):
            key = (piece, i == len(pieces) - 1)
            if len(pieces) == 1:
                ids = self.fragment(*key)
            else:
                ids += self.fragments[0].get(key) or self.keep(self.fragments, key, self.fragments[1].get(key) or self.fragment(*key))
        return self.keep(self.words, word, (struct.pack(f"<{len(ids)}I", *ids), " ".join([self.text_of[i] for i in ids])))

    def split(self, text: str) -> list[str]:
        """A text's words, after NFC and lower-casing character by character (no final sigma). Texts
        with characters newer than Python's tables are normalised by the library's own tables."""
        if text.isascii():
            return self.words_in[0x80](text.lower())
        if max(text) > "\uffff":
            return self.words_in[0x110000](self.by_library(text))
        if self.newer(text):
            return self.words_in[0x10000](self.by_library(text))
        return self.words_in[0x10000](unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids (little-endian, 4 bytes each) and the decoded text of a whole text."""
        packed, shown = [], []
        parts = self.split_special(text) if text and "<|" in text else [text or ""]
        new = self.word
        for i, part in enumerate(parts):
            if i % 2:
                packed.append(struct.pack("<I", self.special[part]))
                shown.append(part)
                continue
            for w in self.split(part):
                ids, tokens = self.words[0].get(w) or new(w)
                if ids:
                    packed.append(ids)
                    shown.append(tokens)
        return b"".join(packed), " ".join(shown)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once in each worker."""
    return Bpe(path)


def default_tokenizer() -> str:
    """Where the public word vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What an encoding may return, by field: its type and how it follows from packed ids and decoded text.
_FIELDS = {
    "n_tokens": (pa.int64(), lambda packed, shown: len(packed) // 4),
    "ids": (pa.list_(pa.int32()), lambda packed, shown: np.frombuffer(packed, "<i4")),
    "decoded": (pa.string(), lambda packed, shown: shown),
    "ids_sha256": (pa.string(), lambda packed, shown: hashlib.sha256(packed).hexdigest()),
    "decoded_sha256": (pa.string(), lambda packed, shown: hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest()),
}
#: Rows that are encoded before they go back to the JVM, so a worker holds few results at a time.
ROWS = 128


def encode_decode(df: DataFrame, path: str, text_col: str = "text", fields: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Adds the named fields of every row's encoding (n_tokens, ids, decoded, ids_sha256,
    decoded_sha256; columns of these names are replaced). Null and empty texts have no tokens and
    decode to the empty text. Very long texts and words are encoded whole, in time that grows with
    their length (words: n log n). Rows are independent, so repeated rows, null ids and columns of any
    other name pass through; an empty table stays empty."""
    text_batches(df.sparkSession)
    kept = df.drop(*fields) if text_col not in fields else df
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                done = [coder.encode(t) for t in part.column(at).to_pylist()]
                new = [pa.array([_FIELDS[f][1](*d) for d in done], _FIELDS[f][0]) for f in fields]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *fields])

    schema = StructType([*kept.schema.fields, *(StructField(f, from_arrow_type(_FIELDS[f][0])) for f in fields)])
    return kept.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, default_tokenizer(), fields=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
