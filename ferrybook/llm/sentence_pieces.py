"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are written one after the other and their suffixes are
sorted. Each piece of the vocabulary is then looked up by binary search; the range of
suffixes that begin with it are its occurrences, each an edge from its start to its
end. Edges are sorted by their end and relaxed from left to right.

The vocabulary is of the merging kind (BPE). A sequence of pieces is its encoding
exactly if each two neighbours, merged from their characters alone, come out as these
two. So each place has one last piece: the edge that agrees with the last piece at its
start. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrybook.llm.words import BYTE_VALUES, chunks, mix, powers, prefix_sums

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
BATCH_BYTES = 1 << 20
#: Ids that are decoded at a time, unless one text alone has more.
DECODED_IDS = 1 << 19
#: Words and pieces that a task remembers before it starts afresh.
KNOWN_WORDS, KNOWN_IDS, KNOWN_PAIRS = 1 << 20, 1 << 23, 1 << 20
#: Bytes of text that are copied and worked on at a time, unless one text has more.
SLICE_BYTES = 1 << 22
GAP = 0xFF  # between words; it occurs in no UTF-8 text


def load_pieces(path: str = MODEL) -> dict:
    """Pieces as bytes (a space for the space mark), their scores, and the byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes | None] = []
    scores, byte_ids = [], [0] * 256
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        usual = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        pieces.append(name.replace(SPACE_MARK, " ").encode() if usual else None)
        scores.append(model.get_score(i))
    return {"pieces": pieces, "scores": scores, "byte_ids": byte_ids}


def merge(text: str, rank: dict[str, float]) -> list[str]:
    """Merge characters: always the neighbours whose union scores best, leftmost first."""
    parts: list[str | None] = list(text)
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap: list[tuple[float, int, str]] = []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0:
            union = parts[left] + parts[right]
            if union in rank:
                heapq.heappush(heap, (-rank[union], left, union))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, left, union = heapq.heappop(heap)
        right = after[left] if parts[left] is not None else -1
        if right < 0 or parts[left] + parts[right] != union:
            continue
        parts[left], parts[right] = union, None
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [p for p in parts if p is not None]


def sort_suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first ``depth`` bytes, and the first eight bytes in its order."""
    padded = np.concatenate((data, np.zeros(depth + 16, dtype=np.uint8)))

    def eight(places: np.ndarray | slice, at: int) -> np.ndarray:
        out = np.zeros(len(data) if isinstance(places, slice) else len(places), dtype=np.uint64)
        for j in range(at, at + 8):
            column = padded[j : j + len(data)] if isinstance(places, slice) else padded[places + j]
            out = out << np.uint64(8) | column
        return out

    head = eight(slice(None), 0)
    order = np.argsort(head, kind="stable")
    head = head[order]
    tied = np.zeros(len(order), dtype=bool)
    same = head[1:] == head[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    where = np.flatnonzero(tied)
    places = order[where]
    keys = [eight(places, at) for at in range(8, depth, 8)]
    if len(where) and keys:
        order[where] = places[np.lexsort((*keys[::-1], head[where]))]
    return order, head


class Encoder:
    """Encodes batches; remembers the words it has met and which pieces agree."""

    def __init__(self, pieces: list[bytes | None], scores: list[float], byte_ids: list[int]):
        self.names = [p.decode() if p is not None else None for p in pieces]
        self.rank = {n: s for n, s in zip(self.names, scores) if n is not None}
        self.byte_ids = byte_ids
        usual = sorted((p, i) for i, p in enumerate(pieces) if p is not None)
        self.sorted_bytes = [p for p, _ in usual]
        self.sorted_ids = np.array([i for _, i in usual], dtype=np.int64)
        self.lengths = np.array([len(p) for p in self.sorted_bytes], dtype=np.int64)
        self.depth = int(self.lengths.max())
        heads = [p[:8] for p in self.sorted_bytes]
        self.low = np.array([int.from_bytes(h.ljust(8, b"\0"), "big") for h in heads], dtype=np.uint64)
        self.high = np.array([int.from_bytes(h.ljust(8, b"\xff"), "big") for h in heads], dtype=np.uint64)
        self.size_of = np.array([len(p or b"") for p in pieces], dtype=np.int64)
        self.single = {n: i for i, n in enumerate(self.names) if n is not None and len(n) == 1}
        self.agreed: dict[int, bool] = {}
        self.extra: list[str] = []  # characters without a piece, numbered after the pieces
        self.extra_ids: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.words = np.zeros(0, dtype=np.uint64)
        self.begins = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def name(self, piece: int) -> str:
        return self.names[piece] if piece < len(self.names) else self.extra[piece - len(self.names)]

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece."""
        order, head = sort_suffixes(data, self.depth)
        first = np.searchsorted(head, self.low, side="left")
        last = np.searchsorted(head, self.high, side="right")
        for k in np.flatnonzero((self.lengths > 8) & (last > first)):
            # The rest of a longer piece, by binary search in the range of its head.
            piece = self.sorted_bytes[k]
            size, begin, stop = len(piece), int(first[k]), int(last[k])
            read = lambda i: data[order[i] : order[i] + size].tobytes()
            a, b = begin, stop
            while a < b:
                middle = (a + b) // 2
                a, b = (middle + 1, b) if read(middle) < piece else (a, middle)
            first[k], b = a, stop
            while a < b:
                middle = (a + b) // 2
                a, b = (middle + 1, b) if read(middle) <= piece else (a, middle)
            last[k] = a
        found = last - first
        kind = np.repeat(np.arange(len(found)), found)
        places = np.arange(len(kind)) - np.repeat(np.cumsum(found) - found, found) + first[kind]
        return order[places], self.sorted_ids[kind]

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two neighbours stay as they are when merged from their characters."""
        code = left << 32 | right
        pairs, back = np.unique(code, return_inverse=True)
        out = np.empty(len(pairs), dtype=bool)
        if len(self.agreed) > KNOWN_PAIRS:
            self.agreed.clear()
        for k, pair in enumerate(pairs.tolist()):
            known = self.agreed.get(pair)
            if known is None:
                a, b = self.name(pair >> 32), self.name(pair & 0xFFFFFFFF)
                known = self.agreed[pair] = merge(a + b, self.rank) == [a, b]
            out[k] = known
        return out[back]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Pieces of words that lie in ``data`` with gaps between: counts and all ids."""
        start, piece = self.edges(data)
        size = self.size_of[piece]
        # An edge for each character that is no piece.
        covered = np.zeros(len(data) + 1, dtype=bool)
        width = np.ones(len(data), dtype=np.int64)
        for low, bytes_ in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            width[data >= low] = bytes_
        covered[start[size == width[start]]] = True
        alone = np.flatnonzero(((data & 0xC0) != 0x80) & (data != GAP) & ~covered[:-1])
        if len(alone):
            chars = [data[p : p + width[p]].tobytes().decode() for p in alone]
            for c in chars:
                if c not in self.extra_ids:
                    self.extra_ids[c] = len(self.names) + len(self.extra)
                    self.extra.append(c)
            start = np.concatenate((start, alone))
            piece = np.concatenate((piece, np.array([self.extra_ids[c] for c in chars])))
            size = np.concatenate((size, width[alone]))
        end = start + size
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))[start]
        place = end - starts[word]
        # By place within the word, then by end, longest first.
        order = np.argsort(place << 38 | end << 6 | (63 - np.minimum(size, 63)), kind="stable")
        start, piece, end, place = start[order], piece[order], end[order], place[order]
        begins = start == starts[word[order]]
        last = np.full(len(data) + 1, -1, dtype=np.int64)
        limits = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
        for a, b in zip(limits[:-1], limits[1:]):
            todo = np.arange(a, b)
            while len(todo):
                # The longest edge left of each end.
                head = np.append(True, end[todo][1:] != end[todo][:-1])
                tried = todo[head]
                before = last[start[tried]]
                ok = begins[tried].copy()
                ask = np.flatnonzero(~ok & (before >= 0))
                ok[ask] = self.agree(before[ask], piece[tried[ask]])
                last[end[tried[ok]]] = piece[tried[ok]]
                todo = todo[~head]
                todo = todo[last[end[todo]] < 0]
        sizes_of = np.concatenate((self.size_of, [len(c.encode()) for c in self.extra])).astype(np.int64)
        at, owner, steps = starts + sizes, np.arange(len(starts)), []
        while len(owner):
            token = last[at]
            steps.append((owner, token))
            at = at - sizes_of[token]
            going = at > starts[owner]
            at, owner = at[going], owner[going]
        owner = np.concatenate([s[0] for s in steps])[::-1]
        token = np.concatenate([s[1] for s in steps])[::-1]
        order = np.argsort(owner, kind="stable")
        owner, token = owner[order], token[order]
        if self.extra:  # bytes of the characters without a piece
            times = np.where(token < len(self.names), 1, sizes_of[token])
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner, token = np.repeat(owner, times), np.repeat(token, times)
            for k in np.flatnonzero(token >= len(self.names)):
                token[k] = self.byte_ids[self.extra[token[k] - len(self.names)].encode()[nth[k]]]
        return np.bincount(owner, minlength=len(starts)), token.astype(np.int32)

    def learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        words, first = np.unique(hashes, return_index=True)
        new = np.ones(len(words), dtype=bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            new = self.words[at] != words
        if len(self.words) + new.sum() > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.forget()
            new[:] = True
        if not new.any():
            return
        words, first = words[new], first[new]
        size = sizes[first]
        own_starts = np.cumsum(size + 1) - size - 1
        own = np.full(int((size + 1).sum()), GAP, dtype=np.uint8)
        inner = np.repeat(own_starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own[inner] = data[inner - np.repeat(own_starts, size) + np.repeat(starts[first], size)]
        counts, ids = self.encode_words(own, own_starts, size)
        begins = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        at = np.searchsorted(self.words, words)  # both are sorted
        self.words = np.insert(self.words, at, words)
        self.begins = np.insert(self.begins, at, begins)
        self.counts = np.insert(self.counts, at, counts)

    def encode(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """Ids of the texts, in parts that together have all rows in order."""
        texts = texts.cast(pa.large_string())
        mark = pc.replace_substring(texts, SPACE_MARK, " ")
        for chunk in chunks(mark, BATCH_BYTES):
            filled = np.diff(chunk.offsets) > 0
            data = np.insert(chunk.data, chunk.offsets[:-1][filled], 32)
            offsets = chunk.offsets + np.append(0, np.cumsum(filled))
            if not len(data):
                empty = pa.array([], pa.int32())
                yield pa.ListArray.from_arrays(pa.array(np.zeros(len(offsets)), pa.int32()), empty)
                continue
            space = data == 32
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            begin[offsets[:-1][filled]] = True
            starts = np.flatnonzero(begin)
            sizes = np.diff(np.append(starts, len(data)))
            sums = prefix_sums(data, BYTE_VALUES)
            _, down = powers(len(data))
            hashes = mix((sums[starts + sizes] - sums[starts]) * down[starts])
            self.learn(data, starts, sizes, hashes)
            known = np.searchsorted(self.words, hashes)
            counts = self.counts[known]
            ends = np.cumsum(counts)
            ids = self.ids[np.arange(ends[-1]) - np.repeat(ends - counts - self.begins[known], counts)]
            limits = np.append(0, ends)[np.searchsorted(starts, offsets)]
            yield pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids))


def slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose sizes add up to ``limit`` at most, or single rows."""
    ends = np.cumsum(np.asarray(sizes.fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _encode(shared, with_text: bool, verify: bool):
    def rows_of(encoder: Encoder, part: pa.RecordBatch, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        at = 0
        for ids in encoder.encode(part.column(1)):
            rows = part.slice(at, len(ids))
            at += len(ids)
            out = {"id": rows.column(0)}
            if with_text:
                out["text"] = rows.column(1)
            out["ids"] = ids
            if verify:
                out["round_trip"] = pc.equal(decode_batch(ids, bodies), rows.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # The value of a broadcast lives as long as the worker, and with it the encoder.
        if "encoder" not in known:
            known["encoder"] = Encoder(known["pieces"], known["scores"], known["byte_ids"])
        bodies = piece_bodies(known) if verify else []
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(1)), SLICE_BYTES):
                yield from rows_of(known["encoder"], part, bodies)

    return run


def encode_texts(
    docs: DataFrame,
    model_path: str = MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    verify: bool = False,
) -> DataFrame:
    """``id_col``, ``text_col`` and ``ids`` (array of int): the pieces of each whole text.

    The ids are those of the SentencePiece library without begin and end marks. A null
    or empty text has no ids. Repeated rows are all encoded; an empty table gives an
    empty result; other columns are not read. Each batch is worked on alone, without a
    shuffle; the vocabulary is read from ``model_path`` by the driver only. Without
    ``with_text`` the texts are not passed on. With ``verify`` the ids are decoded in
    the same task, and ``round_trip`` tells whether that gives the text (null: empty).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    schema = f"id {kind}, " + "text string, " * with_text + "ids array<int>" + ", round_trip boolean" * verify
    out = docs.mapInArrow(_encode(shared, with_text, verify), schema)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def piece_bodies(known: dict) -> list[bytes]:
    """The bytes that each piece stands for."""
    bodies = [p or b"" for p in known["pieces"]]
    for byte, i in enumerate(known["byte_ids"]):
        bodies[i] = bytes([byte])
    return bodies


def decode_batch(ids: pa.Array, bodies: list[bytes]) -> pa.Array:
    """Texts of lists of ids; ``bodies`` are the bytes of each piece."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    places = np.cumsum(sizes) - sizes
    body = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    offsets = np.asarray(ids.offsets, dtype=np.int64)
    token = np.asarray(ids.values.slice(offsets[0], offsets[-1] - offsets[0]), dtype=np.int64)
    size = sizes[token]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    data = body[np.arange(total) - np.repeat(ends - size - places[token], size)]
    limits = np.append(0, ends)[offsets - offsets[0]]
    texts = []
    for a, b in zip(limits[:-1], limits[1:]):
        a += a < b and data[a] == 32  # the space put before the text
        texts.append(data[a:b].tobytes().decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = piece_bodies(shared.value)
        for batch in batches:
            for part in slices(batch, pc.list_value_length(batch.columns[-1]), DECODED_IDS):
                texts = decode_batch(part.columns[-1].fill_null([]), bodies)
                names = [*part.schema.names, "decoded"]
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return run


def decode_ids(df: DataFrame, model_path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``: the text of the ids.

    Decoding undoes encoding, but for the mark U+2581, which comes back as a space.
    Null ids give an empty text. ``decoded`` must not be a column of ``df`` already.
    """
    others = [c for c in df.columns if c != ids_col]
    df = df.select(*others, ids_col)
    shared = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_decode(shared), f"{schema}, decoded string")
