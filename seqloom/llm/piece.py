"""SentencePiece BPE encoding and decoding in numpy, with the model file as a parameter.

The words of a chunk (a run of spaces with what follows up to the next one, cut further at signs that no longer piece holds)
are made distinct and merged together: their signs lie in one flat array; in each round every word finds its pair of least
rank and merges it wherever it stands, from the left, without overlap; merged signs are compacted away, and words without a
pair leave. A round falls back to a word's leftmost merge alone if merging one place would make a pair there that ranks
before the one being merged, which is what makes the rounds equal to merging one pair at a time. Texts are then gathers
from the distinct words' ids, and decoding is a gather of the pieces' bytes.

Signs that are no piece become byte pieces. Null and empty texts encode to the end id alone and decode to the empty text.
A text of any length is encoded whole. Repeated rows get equal results, and an empty table an empty result. Extra columns are
not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import flattext as ft
from .tables import table

SPACE = "▁"
_NONE = np.int64(1) << np.int64(40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """The tables of a model: piece ids of signs, merges of pairs, ranks, bytes of pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte pieces, a leading space and the identity normaliser is asked for")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in t.lstrip(SPACE) for _, t, _ in pieces):
            raise ValueError("user-defined or unused pieces, and spaces within pieces, are not handled")
        self.eos, self.size = trainer.eos_id, len(proto.pieces)
        self.bytes_at = np.zeros(256, dtype=np.int64)
        text = [b""] * self.size
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes_at[int(p.piece[3:5], 16)] = i
                text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                text[i] = p.piece.replace(SPACE, " ").encode()
        ids = {t: i for i, t, _ in pieces}
        scores = np.array(sorted({s for _, t, s in pieces if len(t) > 1}, reverse=True))
        self.rank = np.full(self.size, _NONE, dtype=np.int64)
        left, right, made = [], [], []
        for i, t, s in pieces:
            if len(t) > 1:
                self.rank[i] = np.searchsorted(-scores, -s)
                for k in range(1, len(t)):
                    if (a := ids.get(t[:k])) is not None and (b := ids.get(t[k:])) is not None:
                        left.append(a)
                        right.append(b)
                        made.append(i)
        self._index(np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64), np.array(made, dtype=np.int64))
        self.sign = np.full(0x110000, -1, dtype=np.int32)  # id of a sign's own piece
        for i, t, _ in pieces:
            if len(t) == 1:
                self.sign[ord(t)] = i
        inner = {c for _, t, _ in pieces if len(t) > 1 for c in t}
        self.joins = np.zeros(0x110000, dtype=bool)  # signs that longer pieces hold
        self.joins[[ord(c) for c in inner]] = True
        self.cuts = np.array([b < 128 and not self.joins[b] and b != 0x20 for b in range(256)])  # single bytes to cut words at
        self.piece_len = np.array([len(t) for t in text], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        names = [str(i).encode() + b" " for i in range(self.size)]
        self.name_len = np.array([len(t) for t in names], dtype=np.int64)
        self.name_start = np.cumsum(self.name_len) - self.name_len
        self.name_bytes = np.frombuffer(b"".join(names), dtype=np.uint8)

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table of the merges, twice the keys or more, with linear probing."""
        bits = int(np.ceil(np.log2(len(keys) + 1))) + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            at = slot[waiting]
            free = self.keys[at] < 0
            placed, lead = np.unique(at[free], return_index=True)
            winners = waiting[free][lead]
            self.keys[placed], self.values[placed] = keys[winners], values[winners]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        slot = self._slot(keys)
        got, out = self.keys[slot], np.full(len(keys), -1, dtype=np.int64)
        hit = got == keys
        out[hit] = self.values[slot[hit]]
        more = np.flatnonzero(~hit & (got >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            got = self.keys[slot[more]]
            hit = got == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.merged(left, right)
        return made, np.where(made >= 0, self.rank[made], _NONE)

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words at once. symbols: ids, or other negative numbers; words: the ascending word of each symbol."""
        done_symbols, done_words = [], []
        made = rank = None
        while len(symbols):
            if made is None:
                made, rank = np.full(len(symbols), -1, dtype=np.int64), np.full(len(symbols), _NONE, dtype=np.int64)
                pair = np.flatnonzero(words[1:] == words[:-1])
                made[pair], rank[pair] = self._ranked(symbols[pair], symbols[pair + 1])
            lead = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            many = np.diff(np.append(lead, len(words)))
            least = np.minimum.reduceat(rank, lead)
            over = least == _NONE
            if over.any():  # no pair left in these words
                gone = np.repeat(over, many)
                done_symbols.append(symbols[gone])
                done_words.append(words[gone])
                symbols, words, made, rank = symbols[~gone], words[~gone], made[~gone], rank[~gone]
                if not len(symbols):
                    break
                many, least = many[~over], least[~over]
                lead = np.cumsum(many) - many
            number = np.repeat(np.arange(len(lead)), many)
            at = np.flatnonzero(rank == least[number])
            # leftmost merges without overlap: every second one of a run of neighbouring places
            start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (number[at[1:]] != number[at[:-1]])])
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            word = number[at]
            first = np.concatenate([[True], word[1:] != word[:-1]])
            if not first.all():
                after = symbols.copy()
                after[at] = made[at]
                right = at + 2
                inside = np.flatnonzero((right < len(symbols)) & (number[np.minimum(right, len(symbols) - 1)] == word))
                early = np.zeros(len(at), dtype=bool)
                early[inside] = self._ranked(made[at[inside]], symbols[right[inside]])[1] <= least[word[inside]]
                inside = np.flatnonzero((at > 0) & (number[at - 1] == word))
                before = at[inside] - 1
                taken = np.zeros(len(symbols) + 1, dtype=bool)
                taken[at + 1] = True
                left = np.where(taken[before], before - 1, before)
                early[inside] |= self._ranked(after[left], made[at[inside]])[1] <= least[word[inside]]
                unsafe = np.bincount(word[early], minlength=len(lead)) > 0
                at = at[first | ~unsafe[word]]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            symbols, words, made, rank = symbols[keep], words[keep], made[keep], rank[keep]
            made[at], rank[at] = -1, _NONE
            touched = np.zeros(len(words), dtype=bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            pair = np.flatnonzero(touched[:-1])
            pair = pair[words[pair] == words[pair + 1]]
            made[pair], rank[pair] = self._ranked(symbols[pair], symbols[pair + 1])
        if not done_symbols:
            return symbols, words
        symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of texts, flat, and the offsets of the texts; each text ends with the end id."""
        rows = len(offsets) - 1
        size = np.diff(offsets)
        # each text gets a leading space; the model's space sign counts as a space
        lead = offsets[:-1] + np.arange(rows)
        body = np.full(len(data) + rows, 0x20, dtype=np.uint8)
        inside = np.ones(len(body), dtype=bool)
        inside[lead] = False
        body[inside] = data
        limit = np.append(lead, len(body))
        marks = np.flatnonzero((body[:-2] == 0xE2) & (body[1:-1] == 0x96) & (body[2:] == 0x81)) if len(body) > 2 else np.zeros(0, dtype=np.int64)
        if len(marks):
            body[marks] = 0x20
            keep = np.ones(len(body), dtype=bool)
            keep[marks + 1] = keep[marks + 2] = False
            limit = np.concatenate([[0], np.cumsum(keep)])[limit]
            body = body[keep]
        space, cut = body == 0x20, self.cuts[body]
        begin = np.zeros(len(body), dtype=bool)
        begin[1:] = (space[1:] & ~space[:-1]) | cut[1:] | cut[:-1]
        begin[limit[:-1][size >= 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(body))
        # an empty text's leading space is no word
        starts_of = np.searchsorted(starts, limit)
        first, code = ft.distinct(body, starts, ends)
        ids, many = self._words(body, starts[first], ends[first])
        begin_at = np.cumsum(many) - many
        count = many[code]
        empty = np.flatnonzero(size == 0)
        count[starts_of[empty]] = 0
        total = np.concatenate([[0], np.cumsum(count)])[starts_of]
        flat = ids[ft.spread(begin_at[code], count)]
        out_offsets = total + np.arange(rows + 1)
        out = np.full(len(flat) + rows, self.eos, dtype=np.int64)
        hold = np.ones(len(out), dtype=bool)
        hold[out_offsets[1:] - 1] = False
        out[hold] = flat
        return out, out_offsets

    def _words(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and the number of each."""
        size = ends - starts
        text = body[ft.spread(starts, size)]
        word = np.repeat(np.arange(len(starts)), size)
        head = (text & 0xC0) != 0x80
        at = np.flatnonzero(head)
        wide = text[at].astype(np.int64)
        code = np.where(wide < 0x80, wide, np.where(wide < 0xE0, wide & 0x1F, np.where(wide < 0xF0, wide & 0x0F, wide & 0x07)))
        follow = np.diff(np.append(at, len(text)))
        for k in (1, 2, 3):
            more = follow > k
            code[more] = code[more] << 6 | (text[at[more] + k] & 0x3F)
        code[code == 0x20] = ord(SPACE)
        symbols = self.sign[code].astype(np.int64)
        symbols[symbols < 0] = -1 - code[symbols < 0]
        symbols, words = self.merge(symbols, word[at])
        unknown = symbols < 0
        if unknown.any():  # signs without a piece, as bytes
            value = -1 - symbols[unknown]
            wide = 1 + (value >= 0x80) + (value >= 0x800) + (value >= 0x10000)
            many = np.ones(len(symbols), dtype=np.int64)
            many[unknown] = wide
            place = ft.spread(np.zeros(len(symbols), dtype=np.int64), many)
            words, owner = np.repeat(words, many), np.repeat(np.arange(len(symbols)), many)
            out = symbols[owner]
            odd = out < 0
            value, n, k = -1 - out[odd], many[owner[odd]], place[odd]
            bits = value >> (6 * (n - 1 - k)) & np.where((k > 0) | (n == 1), 0x7F, 0xFF)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
            out[odd] = self.bytes_at[np.where(n == 1, bits, np.where(k > 0, 0x80 | (bits & 0x3F), lead | bits))]
            symbols = out
        return symbols, np.bincount(words, minlength=len(starts))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of flat ids, and the offsets of the texts, as the library decodes: without the first space.

        Ids that aren't pieces of text, such as the end id, stand for nothing. Bytes that aren't UTF-8 are left to the caller.
        """
        size = self.piece_len[ids]
        out = self.piece_bytes[ft.spread(self.piece_start[ids], size)]
        limit = np.concatenate([[0], np.cumsum(size)])[offsets]
        first = limit[:-1][limit[:-1] < limit[1:]]
        first = first[out[first] == 0x20]
        if len(first):
            keep = np.ones(len(out), dtype=bool)
            keep[first] = False
            limit = np.concatenate([[0], np.cumsum(keep)])[limit]
            out = out[keep]
        return out, limit

    def names(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a space after it, as bytes, and the offsets of the texts."""
        size = self.name_len[ids]
        return self.name_bytes[ft.spread(self.name_start[ids], size)], np.concatenate([[0], np.cumsum(size)])[offsets]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(own: Codec, texts: pa.Array):
    """Of a column of texts: ids, decimal names and decoded bytes, flat, with offsets, for each chunk."""
    for _, _, data, offsets in ft.chunks(texts):
        ids, limit = own.encode(data, offsets)
        yield ids, limit, own.names(ids, limit), own.decode(ids, limit)


def _hashes(body: np.ndarray, limit: np.ndarray, less: int = 0) -> list[str]:
    raw = memoryview(body.tobytes())
    return [hashlib.sha256(raw[a : b - less]).hexdigest() for a, b in zip(limit[:-1].tolist(), limit[1:].tolist(), strict=True)]


def encode(documents: DataFrame, path: str | None = None, *keep: str) -> DataFrame:
    """(doc_id, other columns to keep, ids, n_tokens, decoded_sha256): texts as ids, and the hash of what they decode to.

    The model file is read by each worker at ``path``.
    """
    path = path or default_model()
    names = ["doc_id", *keep]
    schema = documents.select(*names).schema

    def encoded(batches):
        own = codec(path)
        for batch in batches:
            made, back, count = [], [], []
            for ids, limit, _, decoded in _encoded(own, ft.filled(batch.column("text"))):
                made.append(pa.ListArray.from_arrays(pa.array(limit.astype(np.int32)), pa.array(ids.astype(np.int32))))
                back += _hashes(*decoded)
                count.append(np.diff(limit))
            ids = pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))
            n = np.concatenate(count) if count else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids, pa.array(n, pa.int64()), pa.array(back, pa.string())], [*names, "ids", "n_tokens", "decoded_sha256"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return documents.select(*names, "text").mapInArrow(encoded, f"{kept}, ids array<int>, n_tokens long, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""
    path = path or default_model()

    def decoded(batches):
        own = codec(path)
        for batch in batches:
            column = batch.column("ids")
            size = np.array([x or 0 for x in column.value_lengths().to_pylist()], dtype=np.int64)
            body, limit = own.decode(column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            raw = body.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(limit[:-1].tolist(), limit[1:].tolist(), strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, the ids decoded, and both hashed."""
    path = path or default_model()

    def hashed(batches):
        own = codec(path)
        for batch in batches:
            count, named, back = [], [], []
            for _, limit, names, decoded in _encoded(own, ft.filled(batch.column("text"))):
                named += _hashes(*names, less=1)
                back += _hashes(*decoded)
                count.append(np.diff(limit))
            n = np.concatenate(count) if count else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(named, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(hashed, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
