"""Byte-level BPE as a monoid: encodings of neighbouring texts are joined in a tree.

Two levels use one idea, re-encoding a window around the seam that grows until what lies outside it provably stays:

* Units of a text: it is cut at its safe blanks, those between two characters that are no white space. Patterns of this kind
  match such a blank only at the start of a piece, so a piece begins there whatever stands before or behind, and units
  away from the seam stay. A window that begins or ends in white space takes in the next unit.
* Tokens of one piece. A sequence of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of
  their own bytes. Both parts are encodings, so the join stands once the pairs at the window's edges are.

Decoding concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crosspanel.llm.common import col, string_texts

#: Characters of a leaf of the text's tree, and bytes of a leaf of a piece's tree.
LEAF_CHARS = 16_384
LEAF_BYTES = 8
NO_RANK = 1 << 62
#: Pieces and pairs whose result a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


def compiled(pattern: str) -> re.Pattern:
    """A pattern with Unicode classes as a standard one: each class is spelt out as ranges of characters."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(kind: str) -> str:
        points = np.array([ord(c) for c in regex.findall(kind, every)])
        cut = np.flatnonzero(np.diff(points) != 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.concatenate([[0], cut + 1])], points[np.concatenate([cut, [-1]])]))

    white = ranges(r"\p{White_Space}")
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in "[]":
            inside = part == "["
        if part == r"\S":
            if inside:
                raise ValueError("\\S inside a set")
            part = f"[^{white}]"
        elif part == r"\s" or part.startswith(r"\p"):
            body = white if part == r"\s" else ranges(part)
            part = body if inside else f"[{body}]"
        out.append(part)
    return re.compile("".join(out))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Remembered(dict):
    """A bounded memory of a function's results."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


#: A blank next to other white space; and the blanks at which a text may be cut.
UNSAFE = re.compile(r"\s | \s")
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Part:
    """A stretch of text, cut at its safe blanks: the units, and the packed ids of each."""

    units: list[str]
    ids: list[bytes]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = compiled(pattern)
        self.pieces = Remembered(lambda piece: np.array(self.encode_piece(piece.encode()), "<u4").tobytes())
        self.units = Remembered(lambda unit: self._first(" " + unit))
        self.windows = Remembered(self._merge)
        self.stable = Remembered(lambda pair: self._merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair))

    # -- tokens of one piece

    def _merge(self, data: bytes) -> list[int]:
        """Leaf or window: join the pair of neighbours with the lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if len(data) <= 4 * LEAF_BYTES:
            parts = [data[i : i + 1] for i in range(len(data))]
            pairs = [ranks.get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
            while pairs and (best := min(pairs)) != NO_RANK:
                at = pairs.index(best)
                joined = parts[at] = parts[at] + parts.pop(at + 1)
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = ranks.get(joined + parts[at + 1], NO_RANK)
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + joined, NO_RANK)
            return [ranks[p] for p in parts]
        # the same order from a heap, for windows of any length
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been joined since
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(both := part[x] + part[y])) is not None:
                    heappush(heap, (r, x, len(both)))
        return [ranks[p] for p in part if p is not None]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes from the encodings of both parts."""
        if not left or not right or self.stable[left[-1], right[0]]:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self.windows[b"".join([self.tokens[t] for t in left[a:] + right[:b]])]
            if (a == 0 or self.stable[left[a - 1], middle[0]]) and (b == len(right) or self.stable[middle[-1], right[b]]):
                return left[:a] + middle + right[b:]
            k *= 2

    def _tree(self, data: bytes) -> list[int]:
        """Encode halves recursively and join them."""
        if len(data) <= LEAF_BYTES:
            return self.windows[data]
        half = len(data) // 2
        return self.join_tokens(self._tree(data[:half]), self._tree(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tree(data)

    # -- units of one text

    def _first(self, unit: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.pattern.findall(unit)])

    def part(self, text: str) -> Part:
        units = SAFE_BLANK.split(text) if UNSAFE.search(text) else text.split(" ")
        get = self.units.__getitem__
        return Part(units, [self._first(units[0]), *map(get, units[1:])])

    def join(self, left: Part, right: Part) -> Part:
        """Encode the unit at the seam anew, with more units around it while it ends in white space."""
        a, b = len(left.units) - 1, 1
        window = left.units[a] + right.units[0]
        while a > 0 and (not window or window[0].isspace()):
            a -= 1
            window = f"{left.units[a]} {window}"
        while b < len(right.units) and (not window or window[-1].isspace()):
            window = f"{window} {right.units[b]}"
            b += 1
        middle = self.part(window)
        if a:  # the window stands behind a blank
            middle.ids[0] = self.units[middle.units[0]]
        return Part(left.units[:a] + middle.units + right.units[b:], left.ids[:a] + middle.ids + right.ids[b:])

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        parts = [self.part(text[i : i + leaf_chars]) for i in range(0, len(text), leaf_chars)] or [Part([], [])]
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return b"".join(parts[0].ids)

    def decode(self, ids: bytes, leaf_tokens: int = 65_536) -> bytes:
        """Bytes of packed ids: leaves are looked up and concatenated up the tree."""
        get = self.tokens.__getitem__
        parts = [b"".join(map(get, np.frombuffer(ids[i : i + 4 * leaf_tokens], "<u4").tolist())) for i in range(0, len(ids), 4 * leaf_tokens)] or [b""]
        while len(parts) > 1:
            parts = [reduce(bytes.__add__, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


def _codec_of(spark, ranks_path: str, pattern: str):
    """The rank file (a vocabulary, bounded by its format) goes to the workers once; each builds its tables once."""
    shared = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(*shared.value))
        return made[0]

    return codec


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (packed, if ``with_ids``), ids_sha256, and decoded_sha256 of the bytes the ids decode to.

    A null text counts as empty and has no tokens. Special tokens in a text are ordinary text. Texts are encoded one
    by one, so repeated rows give equal results and an empty table an empty one; other columns are not read.
    """
    codec = _codec_of(docs.sparkSession, ranks_path, pattern)
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([f for f in fields if with_ids or f.name != "ids"])

    def run(batches):
        c = codec()
        for b in batches:
            packed, ids_hash, text_hash, size = [], [], [], []
            for text in string_texts(b.column(1)):
                ids = c.encode(text)
                size.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    packed.append(ids)
            columns = [b.column(0), pa.array(size, pa.int64()), *([pa.array(packed, pa.binary())] if with_ids else []), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per encoded document: id and text; null ids give a null text, bytes that are no UTF-8 are replaced."""
    codec = _codec_of(encoded.sparkSession, ranks_path, ".")
    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        c = codec()
        for b in batches:
            texts = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(col(id_col), col(ids_col)).mapInArrow(run, schema)
