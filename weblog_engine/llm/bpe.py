"""BPE encoding and decoding over a ``tokenizers`` vocabulary file of the
word-end kind (``word_bpe_49k.json``).

Each word is held as a contiguous array of part ids and the merge ranks of
adjacent parts; the minimum rank is found by scanning, its boundary is deleted
and the two neighbouring ranks are looked up again. Words over
``SCAN_MAX`` parts do the same merges in the same order from a heap, so a word
of any length costs n log n.

Cases: a null text encodes like an empty one (no ids); special tokens written
in a text become their ids; every other text is NFC-normalised, lower-cased and
split as the vocabulary file says. Repeated rows give repeated results, an
empty table gives an empty one, other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

SCAN_MAX = 64
CACHE_MAX = 400_000  # words a worker remembers; bounds its memory only

_NO_RANK = 1 << 60
_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Letters and digits that the tokenizers library, of an older
# Unicode version than the regex library, sees as neither (first-last, hex).
_NEWER = """
    558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4
    a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
    11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8
    16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
    191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
    1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
    2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_LATER = "[" + "".join(rf"\U{a:0>8}-\U{b:0>8}" for a, b in (x.split("-") for x in _NEWER.split())) + "]"
# Capitals that Python's Unicode version does not know yet, with
# their lower-case forms (first-last:first lower-case form, hex).
_NEW_CASES = "1c89-1c89:1c8a a7cb-a7cb:264 a7cc-a7cc:a7cd a7ce-a7ce:a7cf a7d2-a7d2:a7d3 a7d4-a7d4:a7d5 " \
             "a7da-a7da:a7db a7dc-a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
_NEW_LOWER = {c: int(to, 16) + c - int(a, 16) for a, b, to in (x.replace(":", "-").split("-") for x in _NEW_CASES.split())
              for c in range(int(a, 16), int(b, 16) + 1)}
_NEW_CAPITALS = re.compile("[" + "".join(map(chr, _NEW_LOWER)) + "]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Bpe:
    """Encoder and decoder of one vocabulary file (given as its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        # pair of ids -> merge rank and merged id in one integer, so that the
        # least value is the least rank
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), rank << _ID_BITS | vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.added = added
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]
                                   .replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{_LATER})")
                                   .replace(r"[\p{L}]", rf"[\p{{L}}--{_LATER}]").replace(r"[\p{N}]", rf"[\p{{N}}--{_LATER}]"),
                                   regex.VERSION1)
        self.cache: dict[str, bytes] = {}
        self.word_cache: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge adjacent parts, lowest rank first and leftmost among equals."""
        if len(parts) > SCAN_MAX:
            return self._merge_long(parts)
        rank_of = self.merges.get
        ranks = [rank_of(p, _NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            here = parts[i] = least & _ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], here), _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((here, parts[i + 1]), _NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        merges, n = self.merges, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(f, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (f := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = merges[a, b] & _ID_MASK
            gone[j] = 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (f := merges.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (f, left, parts[left], parts[right]))
        return [p for p, dead in zip(parts, gone) if not dead]

    def _word(self, word: str) -> bytes:
        ids = self.word_cache.get(word)
        if ids is None:
            raw = word.encode()
            parts = [self.inner[b] for b in raw]
            parts[-1] = self.final[raw[-1]]
            ids = _packed(self.merge(parts))
            if len(word) <= SCAN_MAX:
                if len(self.word_cache) >= CACHE_MAX:
                    self.word_cache.clear()
                self.word_cache[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one run of letters: the split pattern keeps it whole
            return self._word(chunk)
        return b"".join([self._word(w) for w in self.words.findall(chunk)])

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text.isascii():
            # the vocabulary lower-cases single characters, so a capital
            # sigma has one lower form wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _NEW_CAPITALS.search(text):
                text = text.translate(_NEW_LOWER)
        text = text.lower()
        chunks = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        cache = self.cache
        for chunk in chunks:
            ids = cache.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= SCAN_MAX:
                    if len(cache) >= CACHE_MAX:
                        cache.clear()
                    cache[chunk] = ids
            out.append(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if text:
            if self.specials and "<|" in text:
                for piece in self.specials.split(text):
                    if piece in self.added:
                        out.append(self.added[piece].to_bytes(4, "little"))
                    elif piece:
                        self._plain(piece, out)
            else:
                self._plain(text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by spaces: the vocabulary file names
        no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: list = []  # the vocabulary text that the worker's encoder was made of, and the encoder


def _bpe(shared) -> Bpe:
    """One encoder per worker process; another vocabulary takes its place."""
    text = shared.value
    if not _LOADED or (_LOADED[0] is not text and _LOADED[0] != text):
        _LOADED[:] = text, Bpe(text)
    return _LOADED[1]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: executors need no local copy. Its
    size is that of the file, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of each whole text as little-endian 32-bit integers.
    ``ids_array`` turns them into an array column."""
    spark = df.sparkSession
    prepare(spark)
    shared = vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the text of the ids column made by ``encode``."""
    spark = df.sparkSession
    prepare(spark)
    shared = vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    return df.select(id_col, "ids").mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def ids_array(col: str = "ids"):
    """The packed ids as array<int>."""
    hexed = F.hex(F.col(col))
    n = (F.octet_length(F.col(col)) / 4).cast("int")
    word = lambda i: F.conv(F.concat(*[F.substring(hexed, i * F.lit(8) + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(i).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and SHA-256 of the packed ids and of the text decoded from
    them, in one pass over the texts."""
    spark = df.sparkSession
    prepare(spark)
    shared = vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                                             [id_col, "ids", "decoded"])

    both = df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
    return both.select(
        id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
