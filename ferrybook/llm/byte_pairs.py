"""Byte-level BPE encoding and decoding by backtracking from longest matches.

A text is split by the tokenizer's pattern. A part that is a token is that token.
Otherwise an Aho-Corasick automaton, over bytes written as Latin-1 letters, gives the
longest token that starts at each place of the part. From left to right the longest
one is taken that can stand beside the token before it; where none can, the last
token is taken back and the place is not tried again.

Two neighbours can stand beside each other if merging their joint bytes never joins
them. A text has just one sequence of tokens of which each two neighbours can, and
that is what the merges give; so each place is left at most once as a dead end, and
the work is linear in the length of the part. What is known of two neighbours is
remembered.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Parts, and pairs, that a worker remembers before it forgets those not used lately.
KNOWN_PARTS, KNOWN_PAIRS = 1 << 18, 1 << 20
#: Letters of a remembered part at most; a longer one is worked out each time.
PART_LETTERS = 64
#: Letters of a text that are split in one call; longer texts are split part by part.
SPLIT_LETTERS = 1 << 20
#: Ids in a batch that is passed on, unless one text alone has more.
BATCH_IDS = 1 << 19


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of base64 tokens and numbers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def load_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairs:
    """Encoder of parts: ids of bytes, equal to merging by rank, lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        places = max(ranks.values()) + 1
        self.size = [0] * places
        self.shorter = [-1] * places  # the next shorter token that begins a token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            heads = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((h for h in heads if h >= 0), -1)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda t: t[1]):
            if len(token) > 1 and (halves := self._halves(token, rank)):
                self.halves[rank] = halves
                self.joined[halves] = rank

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two older tokens whose merge is this token."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is None or right is None or max(self._born(left), self._born(right)) >= rank:
                continue
            if self._stay_apart(left, right):
                return left, right
        return None

    def _born(self, token: int) -> int:
        """When a token comes up while merging: its rank; single bytes are there at first."""
        return -1 if self.size[token] == 1 else token

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives these two again.

        Goes back in time: of the two pieces at the border the younger is split again.
        Two older pieces at the border must not have been joined before that merge;
        with equal ranks the merge further left comes first.
        """
        first_unborn = None  # merges at or after this rank had no chance to join them
        while True:
            joined = self.joined.get((left, right))
            if joined is not None and (first_unborn is None or joined < first_unborn):
                return False
            if self._born(left) > self._born(right):
                first_unborn, left = left, self.halves[left][1]
            elif self._born(right) >= 0:
                first_unborn, right = right + 1, self.halves[right][0]
            else:
                return True

    def stay_apart(self, left: int, right: int) -> bool:
        found = self._stay_apart(left, right)
        if len(self.known) >= KNOWN_PAIRS:
            self.known.clear()
        self.known[left, right] = found
        return found

    def encode(self, part: bytes) -> list[int]:
        whole = self.ranks.get(part)
        if whole is not None:
            return [whole]
        size, shorter, known = self.size, self.shorter, self.known
        longest = [-1] * (len(part) + 1)
        for end, token in self.automaton.iter(part.decode("latin-1")):
            longest[end - size[token] + 1] = token  # a later end is a longer token
        dead = bytearray(len(part) + 1)
        ids: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < len(part):
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if last < 0:
                        break
                    apart = known.get((last, token))
                    if apart is None:
                        apart = self.stay_apart(last, token)
                    if apart:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last, token = end, token, longest[end]
                continue
            if not ids:
                raise ValueError("the vocabulary lacks a byte of the text or a way to merge it")
            dead[at] = 1
            token = ids.pop()
            at -= size[token]
            token, last = shorter[token], ids[-1] if ids else -1
        return ids


class PartIds(dict):
    """Ids of parts as 32-bit numbers in bytes; unknown ones are worked out and remembered.

    When it is full, what it has becomes the older half, which goes when it is full again.
    """

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs, self.older = pairs, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.pairs.encode(part.encode())).tobytes()
        if len(part) <= PART_LETTERS:
            if len(self) >= KNOWN_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


def ids_of(text: str, pattern, known: PartIds) -> bytes:
    """Ids of a whole text; a very long one is split some thousand parts at a time."""
    if len(text) <= SPLIT_LETTERS:
        return b"".join([known[p] for p in pattern.findall(text)])
    ids = bytearray()
    parts = (match.group() for match in pattern.finditer(text))
    while some := list(islice(parts, 4096)):
        ids += b"".join([known[p] for p in some])
    return bytes(ids)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        state = shared.value
        # The value of a broadcast lives as long as the worker, and with it the tables.
        if "parts" not in state:
            state["parts"] = PartIds(BytePairs(state["ranks"]))
            state["compiled"] = regex.compile(state["pattern"])
        known, pattern = state["parts"], state["compiled"]
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.binary())
            begin, offsets, ids = 0, [0], []
            for row in range(batch.num_rows):
                body = texts[row].as_py() or b""
                ids.append(ids_of(body.decode("utf-8", "replace"), pattern, known))
                offsets.append(offsets[-1] + len(ids[-1]) // 4)
                if offsets[-1] >= BATCH_IDS or row == batch.num_rows - 1:
                    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(begin, len(lists)), lists], names=["id", "ids"]
                    )
                    begin, offsets, ids = row + 1, [0], []

    return run


def encode_bytes(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int): the tokens of each whole text.

    ``ranks_path`` is a file of base64 tokens with their ranks, read by the driver only;
    by default that of the public tokenizer ``TOKENIZER``. ``pattern`` splits the texts.
    The ids are those of the tiktoken library for ordinary text: names of special tokens
    are text like any other. The vocabulary must hold all 256 bytes, and each longer
    token must come from merging two older ones.

    A null or empty text has no ids. Bytes that are no UTF-8 count as U+FFFD. Repeated
    rows are all encoded; an empty table gives an empty result; other columns are not
    read. Each batch is worked on alone, without a shuffle, and passed on in parts of
    some hundred thousand ids; a single text may be of any length.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(
        {"ranks": load_ranks(ranks_path), "pattern": pattern or load_pattern()}
    )
    out = docs.mapInArrow(_encode(shared), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = np.empty(max(shared.value) + 1, dtype=object)
        for token, body in shared.value.items():
            bodies[token] = body
        for batch in batches:
            lists = batch.columns[-1]
            begin, held, out = 0, 0, []
            for row in range(batch.num_rows):
                ids = lists[row].values
                out.append(b"" if ids is None else b"".join(bodies[ids.to_numpy(zero_copy_only=False)].tolist()))
                held += 0 if ids is None else len(ids)
                if held >= BATCH_IDS or row == batch.num_rows - 1:
                    rows = batch.slice(begin, len(out))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(out, pa.binary())], names=[*rows.schema.names, "bytes"]
                    )
                    begin, held, out = row + 1, 0, []

    return run


def decode_bytes(df: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (binary): the bytes that the ids stand for.

    Null ids give no bytes. Bytes and not letters come back, as a list of ids may end
    inside a letter. Other columns are not read; all rows are kept.
    """
    df = df.select(F.col(id_col).alias("id"), "ids")
    kind = df.schema["id"].dataType.simpleString()
    bodies = {rank: token for token, rank in load_ranks(ranks_path).items()}
    shared = df.sparkSession.sparkContext.broadcast(bodies)
    out = df.mapInArrow(_decode(shared), f"id {kind}, ids array<int>, bytes binary")
    return out.withColumnsRenamed({"id": id_col, "bytes": "decoded"})
