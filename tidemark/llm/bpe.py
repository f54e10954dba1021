"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it into chunks, so texts that share a passage share its chunks wherever the
passage stands. Every worker keeps the chunks it has encoded, and encodes each once. A chunk's tokens are exact only between
its first and its last safe place: a space between two characters that are not white space always starts a new
word for the tokenizer, whatever surrounds it, and no special token holds a space. So a chunk keeps the ids between those places,
and each chunk join (the tail before it, the head behind it, and whole chunks without two safe places) is encoded anew from safe place to
safe place, where both sides agree in every context.

Text between safe places is encoded by ranks with the tokenizer's own vocabulary where that is known to give the same ids (a
byte-level BPE whose ids follow its merges, Latin text, no special tokens), else by the tokenizer itself.

No shuffle. Memory of a worker is bounded by its store of chunks and its batch. The tokenizer file is read on the driver and
broadcast.

Defined results: a null text is empty, with no tokens and the digests of the empty text; special tokens in a text count as the
tokenizer reads them; rows are never merged.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.words import bounded_batches, free_names

WINDOW = 16
MASK = (1 << 10) - 1  # chunks of about 1 kB
KEPT_BYTES = 24 << 20
LAST = 200  # the last safe place of a chunk is sought among so many characters
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level tokenizers of this kind split a text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond Latin letters, and in very long words, only the tokenizer's own library is relied on.
RARE = re.compile(r"[^\x00-\u024F]|\S{2000}")
PRIME = np.uint32(0x01000193)


def cut_places(raw: bytes, window: int = WINDOW, mask: int = MASK) -> list[int]:
    """Byte offsets where a text is cut: where the hash of the last ``window`` bytes ends in zeros, at starts of characters."""
    if len(raw) <= window:
        return []
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = np.zeros(len(b) - window, np.uint32)
    for i in range(window):
        h = h * PRIME + b[i : i + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(((h >> np.uint32(12)) & np.uint32(mask)) == 0) + window
    return at[(b[at] & 0xC0) != 0x80].tolist()


class Recent(dict):
    """What was made lately: when the store is full, all move to an older one, from which used ones come back."""

    def __init__(self, make, limit: int, size=None):
        super().__init__()
        self.make, self.limit, self.size, self.held, self.old = make, limit, size, 0, {}

    def __missing__(self, key: str):
        old = self.old
        value = old.pop(key) if key in old else self.make(key)
        self.held += self.size(key) if self.size else 1
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value


def byte_of() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_core(spec: dict) -> tiktoken.Encoding | None:
    """A rank-merging encoder with the tokenizer's own vocabulary, if it is byte-level BPE whose ids follow its merges.

    Such a vocabulary gives the same ids either way; any other tokenizer only works through its own library.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    table, vocab = byte_of(), model["vocab"]
    merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(table[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes and decodes texts with one tokenizer, reusing chunks. An encoded text is its ids as text, and what they decode to."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.core = rank_core(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunks = Recent(self._chunk, KEPT_BYTES, lambda chunk: 4 * len(chunk) + 500)

    def between(self, text: str) -> tuple[str, str]:
        """Exact ids of a text that starts and ends at safe places or ends of the document."""
        if not text:
            return "", ""
        if self.core and not RARE.search(text) and not any(x in text for x in self.special):
            ids = self.core.encode_ordinary(text)
            return ",".join(map(str, ids)), self.core.decode(ids)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ",".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _chunk(self, text: str) -> tuple[str, tuple | None, str]:
        """Head before the first safe place, encoded middle, tail from the last one on; no middle: all is head."""
        first = SAFE.search(text)
        last = max((m.start() for m in SAFE.finditer(text, max(0, len(text) - LAST))), default=-1)
        if first is None or last <= first.start():
            return text, None, ""
        return text[: first.start()], self.between(text[first.start() : last]), text[last:]

    def encode(self, text: str | None) -> tuple[str, str]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        cuts = cut_places(raw)
        out, join = [], ""
        for a, b in zip([0, *cuts], [*cuts, len(raw)]):
            chunk = raw[a:b].decode("utf-8", "surrogatepass")
            head, middle, tail = self.chunks[chunk] if cuts else (chunk, None, "")
            join += head
            if middle is not None:
                out += [self.between(join), middle]
                join = tail
        out.append(self.between(join))
        return ",".join([o[0] for o in out if o[0]]), "".join([o[1] for o in out])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """The worker's encoder for a tokenizer; it outlives the task, so chunks are reused between tasks."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """Every row of ``docs`` less its text, with ``n_tokens``, digests of the ids and of the decoded text, and the ``ids``.

    A column of ``docs`` that has one of these names keeps its values under that name with an underscore before it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [T.LongType(), T.StringType(), T.StringType()] + [T.ArrayType(T.IntegerType())] * with_ids
    arrow = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def row(coder: Encoder, text):
        ids, decoded = coder.encode(text)
        n = ids.count(",") + 1 if ids else 0
        out = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()]
        return out + [np.fromstring(ids, np.int32, sep=",") if n else np.empty(0, np.int32)] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(content.value)
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            found = [row(coder, t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *columns], names=[*[batch.schema.names[i] for i in keep], *names])

    own = [c for c in docs.columns if c.lower() in names]
    rows = docs.withColumnsRenamed(dict(zip(own, free_names([*docs.columns, *names], *own))))
    rows = bounded_batches(rows).withColumn("text", F.col("text").cast("string"))
    fields = [f for f in rows.schema.fields if f.name != "text"] + [T.StructField(n, k) for n, k in zip(names, kinds)]
    return rows.mapInArrow(work, T.StructType(fields))
