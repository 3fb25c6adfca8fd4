"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves of at most ``LEAF_CHARS`` characters; a leaf is encoded alone, then neighbours are
joined up the tree. A join encodes a window around the cut again and grows it until the tokens outside provably stay:

* Between a character that is no white space and a space or line feed after it, the splitting pattern always ends a
  match, and what it matches on either side depends on that side alone (no alternative spans the place, and the one
  look-ahead, for white space runs, looks past it only from the right). Encodings on the two sides of such a place
  are independent, so a window from the last such place before the cut to the first one after it is enough.
* A run without such a place is split by the pattern, and each long match is reduced by the same tree over its bytes.
  There a token sequence is the encoding of its bytes if and only if each two neighbours are the encoding of theirs,
  so the window of tokens grows until both of its edges hold.

Decoding halves the ids the same way and concatenates bytes up the tree, which needs no window.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from sys import byteorder

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, col, rows, small_batches, worker_cache

HARD = re.compile(r"(?<=[\w.,;:!?'\"()-])[ \n]")
LEAF_CHARS, LEAF_BYTES, LEAF_IDS, WINDOW = 128, 128, 1024, 32


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def last_hard(text: str, low: int, high: int, after: int) -> int | None:
    """The last place before ``high`` where matches on either side are independent, not before ``low`` and behind ``after``."""
    while True:
        high = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
        if high <= after:
            return None
        if HARD.match(text, high):
            return high


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = self.base.encode_ordinary
        self.sizes = array("I", bytes(4 * (max(ranks.values(), default=0) + 1)))
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str | None) -> list[int]:
        return self._span(text, 0, len(text)) if text else []

    def _span(self, text: str, i: int, j: int) -> list[int]:
        if j - i <= LEAF_CHARS or not HARD.search(text, i + 1, j):
            return self._run(text, i, j)
        mid = (i + j) // 2
        return self._join(text, i, mid, j, self._span(text, i, mid), self._span(text, mid, j))

    def _join(self, text: str, i: int, mid: int, j: int, left: list[int], right: list[int]) -> list[int]:
        start, end, width = (mid, mid, 0) if HARD.match(text, mid) else (None, None, WINDOW)
        while start is None or end is None:
            if start is None:
                low = max(i, mid - width)
                start = last_hard(text, low, mid, i)
                if start is None and low == i:
                    start = i
            if end is None:
                high = min(j, mid + width)
                place = HARD.search(text, mid + 1, high)
                end = place.start() if place else j if high == j else None
            width *= 2
        # a token boundary is certain at both ends of the window, so its old tokens are those of as many bytes
        size, gone = len(text[start:mid].encode("utf-8")), 0
        while size > 0:
            gone += 1
            size -= self.sizes[left[-gone]]
        del left[len(left) - gone :]
        if start < end:
            left += self._run(text, start, end)
        size, gone = len(text[mid:end].encode("utf-8")), 0
        while size > 0:
            size -= self.sizes[right[gone]]
            gone += 1
        left += right[gone:] if gone else right
        return left

    def _run(self, text: str, i: int, j: int) -> list[int]:
        """The encoding of a part of a text alone: of a leaf at once, of a longer one by the pattern's matches in it."""
        if j - i <= LEAF_CHARS:
            return self.leaf(text[i:j])
        out = []
        for match in self.pattern.findall(text[i:j]):
            data = match.encode("utf-8")
            whole = self.ranks.get(data)
            out += self.piece(data) if whole is None else [whole]
        return out

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the pattern, or of a part of its bytes."""
        if len(data) <= LEAF_BYTES:
            return self.base._encode_single_piece(data)
        half = len(data) // 2
        return self._join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            part = self.base.decode_bytes(left[a:] + right[:b])
            window = self.base._encode_single_piece(part) if len(part) <= 4 * LEAF_BYTES or (a == 0 and b == len(right)) else self.piece(part)
            if (a == 0 or self._neighbours(left[a - 1], window[0])) and (b == len(right) or self._neighbours(window[-1], right[b])):
                return left[:a] + window + right[b:]
            size *= 2

    def _neighbours(self, x: int, y: int) -> bool:
        return self.base._encode_single_piece(self.base.decode_bytes([x, y])) == [x, y]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.base.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def unpack(packed: bytes | None) -> list[int]:
    ids = array("I", packed or b"")
    if byteorder == "big":
        ids.byteswap()
    return ids.tolist()


def read_ranks(spark: SparkSession, path: str):
    """The rank file of the driver, for all executors; vocabularies are a few MB at most."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(ranks, pattern: str) -> TreeEncoder:
    """The worker's encoder; a worker holds one at a time."""
    held = worker_cache()
    key = ("bpe", ranks.id if hasattr(ranks, "id") else 0, pattern, len(ranks.value))
    if held.get("bpe_key") != key:
        held.pop("bpe", None)
        held["bpe_key"], held["bpe"] = key, TreeEncoder(parse_ranks(ranks.value), pattern)
    return held["bpe"]


def _mapped(df: DataFrame, fields: list[tuple[str, str, pa.DataType]], keep: tuple[str, ...], of_row, ranks, pattern: str) -> DataFrame:
    """``fields`` by ``of_row(encoder, second column)`` after the first column, then the long columns ``keep``."""
    columns = [*fields, *((c, "long", pa.int64()) for c in keep)]
    schema = pa.schema([(name, kind) for name, _, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        yield from batches_of(schema, ((doc, *of_row(encoder, given), *more) for doc, given, *more in rows(batches, step=64)))

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind, _ in columns))


def _texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *(col(c).cast("long").alias(c) for c in keep))


DOC, IDS, DECODED = ("doc_id", "long", pa.int64()), ("ids", "binary", pa.binary()), ("decoded", "binary", pa.binary())
COUNT, IDS_SHA, DECODED_SHA = ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())


def encode_documents(docs: DataFrame, ranks, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, packed as little-endian unsigned 32-bit integers.

    One row for each input row, in the input's order, and with its long columns ``keep``. Null and empty texts have no
    ids (an empty binary). Repeated rows, null ids and other columns don't matter: rows are independent.
    """
    return _mapped(_texts(docs, id_col, text_col, keep), [DOC, IDS], keep, lambda e, text: (pack(e.encode(text)),), ranks, pattern)


def decode_documents(encoded: DataFrame, ranks, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ids, decoded``, and ``keep``: the bytes of the ids of ``encode_documents``; null ids give no bytes."""
    given = encoded.select("doc_id", "ids", *keep)
    return _mapped(given, [DOC, IDS, DECODED], keep, lambda e, packed: (packed, e.decode(unpack(packed))), ranks, pattern)


def round_trip(docs: DataFrame, ranks, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, the packed ids if wanted, and ``keep``.

    Encodes each text and decodes its packed ids again in one worker, which builds one encoder. Rows are as those of
    ``encode_documents``: null and empty texts have no ids and the digests of nothing.
    """

    def both(e: TreeEncoder, text: str | None) -> tuple:
        ids = pack(e.encode(text))
        decoded = e.decode(unpack(ids))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *([ids] if with_ids else [])

    return _mapped(_texts(docs, id_col, text_col, keep), [DOC, COUNT, IDS_SHA, DECODED_SHA, *([IDS] if with_ids else [])], keep, both, ranks, pattern)


def count_ids(packed: str | Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and bytes."""
    return decoded.select("doc_id", count_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
