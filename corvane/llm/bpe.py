"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text is a row of symbols. Leaf i of the tree holds the rank of the pair that symbol i forms with its right
neighbour, so the root names the lowest rank and, among equals, the leftmost place. Each merge updates three leaves: O(log n)
a merge, O(n log n) a piece, however long a piece without a blank may be. The rule is the tokenizer file's own: normaliser,
splitter, byte alphabet, end-of-word mark, and its added tokens, which are cut out of the raw text first.

Pieces repeat, so each worker remembers those met lately, in two generations of `CACHE_CHARS` characters: a bound on memory that
cannot change a result. Texts leave Arrow `SLICE` at a time.

Defined results: null and empty texts have no tokens (hash of nothing); repeated rows are encoded alike, one row each; very
long texts are encoded whole, in one task row; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corvane.llm._common import light_batches, table

#: Characters of distinct pieces in a generation of what a worker remembers; texts taken out of Arrow at once.
CACHE_CHARS, SLICE = 1_000_000, 256
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free character from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


# What the tokenizer library's Unicode tables do not hold and those of the regular expressions here do (first and last
# code points of letters and digits), and capital letters that its tables lower and those of Python do not (first, last, shift).
LATE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CF, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LOWERED = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))


def newer() -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATE)


class PairTree:
    """A minimum segment tree over (rank, place), packed into one integer a node."""

    def __init__(self, ranks: list[int]) -> None:
        n = self.size = len(ranks)
        node = self.node = [NONE] * n + [r if r == NONE else r << 32 | i for i, r in enumerate(ranks)]
        for i in range(n - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        if not n:
            node.extend((NONE, NONE))

    def root(self) -> int:
        return self.node[1]

    def put(self, place: int, rank: int) -> None:
        node, i = self.node, place + self.size
        node[i] = rank if rank == NONE else rank << 32 | place
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                return
            node[i] = low


class WordBpe:
    """Encodes and decodes as a tokenizer file of kind BPE with an end-of-word suffix says."""

    def __init__(self, spec: str) -> None:
        told = json.loads(spec)
        model = told["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        split = split.replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(split).findall
        late = newer()
        self.late = re.compile(f"[{late}{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b, _ in LOWERED)}]").search
        self.lowered = {c: c + shift for a, b, shift in LOWERED for c in range(a, b + 1)}
        self.careful = regex.compile("(?V1)" + split.replace(r"\p{L}", rf"[\p{{L}}--[{late}]]").replace(r"\p{N}", rf"[\p{{N}}--[{late}]]")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.letters = byte_alphabet()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def symbols(self, piece: str) -> list[int]:
        """The vocabulary's symbols of a piece before any merge; one that the vocabulary lacks is left out."""
        letters = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        return [self.vocab[s] for s in letters if s in self.vocab]

    def merged(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        pair = self.merge.get
        none = (NONE, 0)
        ranks = [pair(two, none)[0] for two in pairwise(ids)]
        if min(ranks) == NONE:
            return ids
        tree = PairTree(ranks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)
        while (low := tree.root()) != NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i] = pair((ids[i], ids[j]))[1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NONE)
            if k < n:
                before[k] = i
                tree.put(i, pair((ids[i], ids[k]), none)[0])
            else:
                tree.put(i, NONE)
            if (h := before[i]) >= 0:
                tree.put(h, pair((ids[h], ids[i]), none)[0])
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> tuple[bytes, str]:
        """The ids of a piece as little-endian unsigned 32-bit integers, and their tokens joined by blanks."""
        got = self.known.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                ids = self.merged(self.symbols(piece))
                got = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
            if self.held + len(piece) > CACHE_CHARS:
                self.older, self.known = self.known, {}
                self.held = 0
            self.known[piece] = got
            self.held += len(piece)
        return got

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """What `piece` says of each piece of a text, added tokens included."""
        out: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append((struct.pack("<I", self.added[part]), self.token[self.added[part]]))
            elif part:
                pieces = self.pieces
                if not part.isascii():
                    if self.late(part):
                        pieces, part = self.careful, part.translate(self.lowered)
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # letters are lowered one by one, without a final sigma
                get, make = self.known.get, self.piece
                for p in pieces(part.lower()):
                    got = get(p)
                    if got is None:
                        got = make(p)
                        get = self.known.get
                    out.append(got)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([ids for ids, _ in self.parts(text)])

    def encode(self, text: str) -> list[int]:
        packed = self.packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by blanks: the file names no decoder. Ids that it lacks are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])

    def digests(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        packed, said = b"".join([ids for ids, _ in parts]), " ".join([said for ids, said in parts if ids])
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=2)
def _coder(spec: str) -> WordBpe:
    return WordBpe(spec)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with_tokens adds ids (array<int>) and decoded (string).

    The tokenizer file (a fixed public vocabulary, under 2 MB) is read once by the driver and sent to the tasks as a broadcast.
    """
    spark = docs.sparkSession
    light_batches(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for batch in (b.slice(start, SLICE) for b in batches for start in range(0, b.num_rows, SLICE)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = list(map(coder.digests, texts))
            cols = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
            if with_tokens:
                ids = [coder.encode(t) for t in texts]
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(coder.decode, ids)), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_tokens
    return docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
