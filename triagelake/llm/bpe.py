"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling (gear) hash of the last 16 bytes has its low bits zero, so
passages that documents share are cut alike wherever they stand. Every distinct chunk is encoded
by itself, once, and kept for later documents (a bounded cache that outlives tasks). Encodings of
neighbouring chunks do not just concatenate: a word, a merge or a special token may straddle the
cut. Each join is therefore repaired: a span that begins at a pre-token of the left chunk, at least
``GUARD`` bytes before the cut, is encoded anew and compared with the right chunk's own encoding;
where both begin a pre-token at the same byte and have the same ids from there up to ``GUARD`` bytes
before the end of the span, they agree, and the chunk's own ids go on from that place. If they
don't agree the span is widened, at last over the following chunks. A pre-tokenizer reads on from
the end of a pre-token whatever lies before it, so from an agreed place the chunk's own ids are
those of the whole text. The pre-tokens looked at are tokens that begin with a space between two
visible ASCII characters; bytes are counted by the lengths of the tokens. This holds for byte-level tokenizers
that split as this one (checked when a tokenizer is loaded) and if the bytes add up to the text;
otherwise the text is encoded whole.

Ids are decoded by the bytes of their tokens; the joined bytes become text as the library makes it,
a malformed part a replacement character.

Null text is the empty text (no tokens). Special tokens' strings in a text become special
tokens, as the library does by default. Texts of any length are encoded chunk by chunk; rows are
independent, so repeated rows, ties and extra columns need no rule; columns are kept, but for those
that bear a new column's name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import prepare, read

GEAR_BYTES = 16
#: Bits of the rolling hash that are zero at a cut: chunks of about 2 KB.
CUT_BITS = 11
#: Bytes on both sides of a place that what is cut off beyond them cannot reach: longer than any special token.
GUARD, SPAN = 24, 56
CACHE_BYTES = 64 << 20
_GEAR = np.random.default_rng(20240501).integers(0, 2**32, 256, dtype=np.uint32)
_STATE: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(b: np.ndarray) -> np.ndarray:
    """Positions of content-defined cuts of a byte array."""
    if len(b) <= GEAR_BYTES:
        return np.empty(0, np.int64)
    h, width = _GEAR[b], 1
    while width < GEAR_BYTES:  # the hash of 2w bytes from those of w bytes
        h = (h[:-width] << np.uint32(width)) + h[width:]
        width *= 2
    return np.flatnonzero((h & np.uint32(((1 << CUT_BITS) - 1) << 4)) == 0) + GEAR_BYTES


def chunks(data: bytes) -> list[bytes]:
    """The content-defined chunks of a text, cut before a character; they concatenate to data."""
    if len(data) < GEAR_BYTES:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8)
    at = cuts(b)
    at = at[at < len(b)]
    at = at[(b[at] & 0xC0) != 0x80]
    marks = [0, *at.tolist(), len(data)]
    return [data[i:j] for i, j in zip(marks, marks[1:])]


class Encoded:
    """Ids of a chunk, and where its pre-tokens begin: in bytes (``at``) and in ids (``of``)."""

    __slots__ = ("ids", "at", "of")

    def __init__(self, ids: np.ndarray, at: np.ndarray, of: np.ndarray):
        self.ids, self.at, self.of = ids, at, of


class Coder:
    """Encodes and decodes texts with reuse of chunks; keeps ids as little-endian uint32."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.plain = kind["normalizer"] is None and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False) and not any(t[x] for t in kind["added_tokens"] for x in ("lstrip", "rstrip", "single_word", "normalized"))
        self.bytes = token_bytes(self.tokenizer)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.begins = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.guard = max([GUARD, *(len(t.content.encode()) + 1 for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.cache: OrderedDict[bytes, Encoded] = OrderedDict()
        self.room = self.cache_bytes = cache_bytes
        self.reused = self.encoded = self.reused_bytes = self.encoded_bytes = 0

    def fresh(self, texts: list[bytes]) -> list[Encoded | None]:
        """Encodings of texts by themselves; None where the tokens' bytes are not those of the text."""
        found = [e.ids for e in self.encode_batch([x.decode() for x in texts], add_special_tokens=False)]
        n, size = np.array(list(map(len, found)), np.int64), np.array(list(map(len, texts)), np.int64)
        ids = np.fromiter(chain.from_iterable(found), "<u4", n.sum())
        ends, edge = np.append(0, np.cumsum(np.take(self.sizes, ids))), np.append(0, np.cumsum(n))
        whole = (ends[edge[1:]] - ends[edge[:-1]] == size) & self.plain
        place = ends[:-1] - np.repeat(ends[edge[:-1]], n)
        b = np.frombuffer(b"".join(texts) + b" ", np.uint8)
        at = np.minimum(np.repeat(np.cumsum(size) - size, n) + place, len(b) - 2)
        shown = (b > 0x20) & (b < 0x7F)
        begins = (place == 0) | (np.append(False, (b[1:-1] == 0x20) & shown[:-2] & shown[2:])[at])
        of = np.flatnonzero(begins)
        first = np.searchsorted(of, edge)
        where = place[of]
        return [Encoded(ids[i:j], where[a:z], of[a:z] - i) if ok else None for i, j, a, z, ok in zip(edge[:-1].tolist(), edge[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), whole.tolist())]

    def learn(self, wanted: list[bytes]) -> dict[bytes, Encoded | None]:
        """The encoding of each distinct chunk, from the cache or fresh."""
        out: dict[bytes, Encoded | None] = {}
        new: list[bytes] = []
        for p in wanted:
            if p in out:
                self.reused += 1
                self.reused_bytes += len(p)
            elif (hit := self.cache.get(p)) is not None:
                self.cache.move_to_end(p)
                self.reused += 1
                self.reused_bytes += len(p)
                out[p] = hit
            else:
                out[p] = None
                new.append(p)
        for i in range(0, len(new), 512):
            for p, e in zip(new[i : i + 512], self.fresh(new[i : i + 512])):
                out[p] = e
                if e is not None:
                    self.cache[p] = e
                    self.room -= self.weight(p, e)
        self.encoded += len(new)
        self.encoded_bytes += sum(map(len, new))
        while self.room < 0 and self.cache:
            self.room += self.weight(*self.cache.popitem(last=False))
        return out

    @staticmethod
    def weight(chunk: bytes, e: Encoded) -> int:
        return len(chunk) + e.ids.nbytes + e.at.nbytes + e.of.nbytes + 500

    def joined(self, texts: list[list[bytes]], known: dict[bytes, Encoded | None]) -> list[np.ndarray | None]:
        """The ids of each text from those of its chunks. Spans of all texts are encoded together, a join of each a turn."""
        out: list = [None] * len(texts)
        jobs = {}
        for i, parts in enumerate(texts):
            own = [known[p] for p in parts]
            if len(own) < 2:
                out[i] = np.zeros(0, "<u4") if not own else own[0] and own[0].ids
            elif None not in own:
                jobs[i] = self.repair(b"".join(parts), own, np.cumsum([0, *map(len, parts)]))
        asked = {i: next(job) for i, job in jobs.items()}
        while asked:
            again = {}
            for i, e in zip(asked, self.fresh(list(asked.values()))):
                try:
                    again[i] = jobs[i].send(e)
                except StopIteration as done:
                    out[i] = done.value
            asked = again
        return out

    def repair(self, data: bytes, own: list[Encoded], starts: np.ndarray):
        """A generator that asks for the encodings of spans and returns the ids of the whole text (None: encode it whole).

        ``true`` is a byte up to which ids are settled, a place where a pre-token begins."""
        ids: list[np.ndarray] = []
        true, k, n = 0, 0, len(data)  # chunk k's own ids hold from ``true`` on
        while k + 1 < len(own):
            cut, e = int(starts[k + 1]), own[k]
            # the span begins at the last pre-token of the left chunk that lies GUARD bytes before the cut
            j = np.searchsorted(e.at, cut - self.guard - starts[k], "right") - 1
            begin = int(starts[k] + e.at[j]) if j >= 0 else true
            if begin > true:
                lo = np.searchsorted(e.at, true - starts[k])
                ids.append(e.ids[e.of[lo] : e.of[j]])
                true = begin
            wide, k = SPAN, k + 1
            while True:
                while k + 1 < len(own) and cut + wide >= starts[k + 1]:
                    k += 1  # the span reaches over the chunk: agree within a later one
                end = min(n, cut + wide)
                while end < n and data[end] & 0xC0 == 0x80:
                    end += 1
                span = yield data[true:end]
                if span is None:
                    return None
                if end == n:
                    ids.append(span.ids)
                    return np.concatenate(ids)
                place = self.agreed(span, true, end, own[k], int(starts[k]))
                if place is not None:
                    ids.append(span.ids[: span.of[place[0]]])
                    true = place[1]
                    break
                wide *= 2
        lo = np.searchsorted(own[k].at, true - starts[k])
        ids.append(own[k].ids[own[k].of[lo] :] if lo < len(own[k].of) else np.zeros(0, "<u4"))
        return np.concatenate(ids)

    def agreed(self, span: Encoded, begin: int, end: int, own: Encoded, start: int) -> tuple[int, int] | None:
        """The first byte at which both encodings begin a pre-token and from which their ids are the same."""
        last = end - self.guard
        mine = {at: y for y, at in enumerate((own.at[: np.searchsorted(own.at, end - start)] + start).tolist()) if at > begin}
        places = (span.at + begin).tolist()
        stop = int(span.of[min(len(places) - 1, int(np.searchsorted(span.at, last - begin)))])
        for x, at in enumerate(places):
            if at > last:
                break
            if (y := mine.get(at)) is None or at == begin:
                continue
            a, b = int(span.of[x]), int(own.of[y])
            if (own.ids[b : b + stop - a] == span.ids[a:stop]).all() if len(own.ids) >= b + stop - a else False:
                return x, at
        return None

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + size, size)
        return self.flat[at].tobytes().decode("utf-8", "replace").encode()

    def texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        group: list[list[bytes]] = []
        size = 0
        for t in texts:
            group.append(chunks((t or "").encode()))
            size += len(t or "")
            if size > 1 << 20:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
        known = self.learn([p for g in group for p in g])
        for parts, ids in zip(group, self.joined(group, known)):
            if ids is None:
                e = self.tokenizer.encode(b"".join(parts).decode(), add_special_tokens=False)
                yield np.array(e.ids, "<u4").tobytes(), self.tokenizer.decode(e.ids, skip_special_tokens=False).encode()
            else:
                yield ids.astype("<u4").tobytes(), self.decode(ids)


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = special[i].encode() if i in special else bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def coder(path: str) -> Coder:
    import triagelake.llm.bpe as home  # the worker's own module: its cache outlives a task

    if path not in home._STATE:
        home._STATE[path] = Coder(path)
    return home._STATE[path]


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if kept, ids (array<int>); text is left out unless ids are kept.

    A column of docs that has one of the new columns' names is replaced."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    carried = [f for f in docs.schema if f.name not in new and (keep_ids or f.name != text_col)]
    schema = T.StructType([*carried, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            n, ids_sha, text_sha, ids_out = [], [], [], []
            for ids, text in c.texts(batch.column(text_col).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    ids_out.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(x) for x in names] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return docs.mapInArrow(run, schema)


def decode(ids: DataFrame, ids_col: str = "ids", tokenizer: str | None = None, text_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids decode to; null ids give null."""
    prepare(ids.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = T.StructType([*[f for f in ids.schema if f.name != text_col], T.StructField(text_col, T.StringType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = coder(path).tokenizer
        for batch in batches:
            texts = [None if x is None else tok.decode(x, skip_special_tokens=False) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(texts, pa.string())], names=[*names, text_col])

    return ids.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
