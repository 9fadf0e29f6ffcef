"""Byte-level BPE encoding and decoding through a distinct-word table.

Method: texts are split into words (the pre-tokeniser's pieces) by an array
program over code-point classes; the words of a slice go through Arrow's
dictionary encoder, so each distinct word is merged once, and the ids are
joined back by word position.  Decoding joins ids with the id-to-piece table.
The table is per slice with a bounded carry-over between slices of a task,
which needs no shuffle: a table over the whole corpus would have to exchange
one row for every word occurrence.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored, whatever their names.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..shipping import map_arrow
from .common import text_slices
from .textnum import Flat

OTHER, LETTER, NUMBER, SPACE = range(4)
# Unicode's White_Space characters, and the endings that an apostrophe takes in the pre-tokeniser's pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: list[np.ndarray] = []
_loaded: dict[str, "Vocabulary"] = {}


def char_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of byte-level BPE: ranks for merging, pieces for decoding."""

    def __init__(self, spec: bytes):
        import tiktoken

        j = json.loads(spec)
        model, pre = j["model"], j["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or j["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        self.pieces = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items()}
        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        first = len(model["vocab"]) - len(joined)
        if [model["vocab"][m] for m in joined] != list(range(first, first + len(joined))):
            raise ValueError("ids don't follow the order of the merges")
        self.special = {}
        for t in j["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens with strip or word flags aren't supported")
            self.special[t["content"].encode()] = t["id"]
            self.pieces[t["id"]] = t["content"].encode()
        own = {p: i for i, p in self.pieces.items() if p not in self.special}
        self._merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own, special_tokens={})._core_bpe.encode_single_piece
        size = max(self.pieces) + 1
        self.piece_array = pa.array([self.pieces.get(i, b"") for i in range(size)], pa.large_binary())
        self.piece_length = np.array([len(self.pieces.get(i, b"")) for i in range(size)], np.int64)

    def encode_word(self, word: bytes) -> list[int]:
        return [self.special[word]] if word in self.special else self._merge(word)


def load(spec: bytes) -> Vocabulary:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(spec)
    return _loaded[key]


def _special_spans(flat: Flat, specials: list[bytes]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping byte spans of special tokens inside single texts, longer tokens first at equal starts."""
    if not specials or not len(flat.b):
        return []
    data, found = flat.b.tobytes(), []
    for s in specials:
        at = data.find(s)
        while at >= 0:
            found.append((at, -len(s)))
            at = data.find(s, at + 1)
    out, end = [], 0
    for at, neg in sorted(found):
        doc = int(np.searchsorted(flat.off, at, "right")) - 1
        if at >= end and at - neg <= flat.off[doc + 1]:
            out.append((at, at - neg))
            end = at - neg
    return out


def split_words(flat: Flat, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset where each word starts, index of each text's first word (n + 1)); a word ends where the next starts.

    The rules are those of the public pattern: an apostrophe ending; a run of
    letters, of numbers, or of other characters, each with one space before it
    if there is one; white space but for its last character if a word follows;
    the white space that is left.
    """
    if not len(flat.b):
        return np.zeros(0, np.int64), np.zeros(flat.n + 1, np.int64)
    cp = np.frombuffer(flat.b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    pos = np.flatnonzero((flat.b & 0xC0) != 0x80)
    n = len(cp)
    kind = char_classes()[cp]
    border = np.zeros(n + 1, bool)
    border[np.searchsorted(pos, flat.off)] = True
    spans = [(int(np.searchsorted(pos, a)), int(np.searchsorted(pos, b))) for a, b in _special_spans(flat, specials)]
    for a, b in spans:
        border[a] = border[b] = True
    border[0] = border[n] = True
    fresh = border[:n].copy()  # a run starts here
    fresh[1:] |= kind[1:] != kind[:-1]
    blank = cp == 0x20
    joined = np.zeros(n, bool)  # a word that takes the space before it
    joined[1:] = fresh[1:] & (kind[1:] != SPACE) & blank[:-1] & ~border[1:n]
    start = fresh & ~joined
    last = np.zeros(n, bool)  # the last of a run of white space before a word
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:n]
    start |= last
    quote = np.flatnonzero((cp == 0x27) & start & fresh)
    if len(quote):
        room = np.concatenate([cp, np.zeros(2, np.uint32)])
        whole = np.concatenate([border, np.ones(2, bool)])
        for ending in ENDINGS:
            k = len(ending)
            hit = quote.copy()
            for d, ch in enumerate(ending, 1):
                hit = hit[(room[np.minimum(hit + d, n + 1)] == ord(ch)) & ~whole[np.minimum(hit + d, n + 2)]]
            start[hit + 1] = False
            after = hit + 1 + k
            start[after[after < n]] = True
    for a, b in spans:
        start[a + 1 : b] = False
    at = pos[start]
    return at, np.searchsorted(at, flat.off)


class Encoder:
    """Encodes slices of texts; keeps at most ``carry`` words between slices."""

    def __init__(self, vocabulary: Vocabulary, carry: int = 200_000):
        self.v, self.carry, self.known = vocabulary, carry, {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, offsets of each text's ids (n + 1))."""
        flat = Flat(texts)
        at, first = split_words(flat, list(self.v.special))
        offsets = np.concatenate([at, [len(flat.b)]]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat.b)])
        coded = pc.dictionary_encode(words)
        index = coded.indices.to_numpy()
        if len(self.known) > self.carry:
            self.known = {}
        known, entries = self.known, []
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                known[word] = ids = np.array(self.v.encode_word(word), "<u4").tobytes()
            entries.append(ids)
        table = np.frombuffer(b"".join(entries), "<u4")
        length = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        begin = np.cumsum(length) - length
        per_word = length[index] if len(index) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)])
        ids = table[np.repeat(begin[index] - ends[:-1], per_word) + np.arange(ends[-1])] if len(index) else np.zeros(0, "<u4")
        return ids, ends[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each text's UTF-8 bytes from the id-to-piece table; broken sequences become U+FFFD."""
        pieces = self.v.piece_array.take(pa.array(ids))
        data = pieces.buffers()[2]
        data = b"" if data is None else memoryview(data)
        ends = np.concatenate([[0], np.cumsum(self.v.piece_length[ids])])[offsets].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            raw = bytes(data[a:b])
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
        return out


def _read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(_read_spec(vocabulary_path))  # its size is that of one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load(shared.value))
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                ids, off = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null or empty ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(_read_spec(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load(shared.value))
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            ids = lists.flatten().to_numpy().astype("<u4")
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in enc.decode(ids, off)], pa.string())], names=[id_col, "text"])

    return map_arrow(df.select(id_col, ids_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded bytes, and the ids themselves if asked for."""
    shared = df.sparkSession.sparkContext.broadcast(_read_spec(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load(shared.value))
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                ids, off = enc.encode(texts)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                cut = (off * 4).tolist()
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in enc.decode(ids, off)], pa.string()),
                        *lists,
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
                )

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
