"""Byte-level BPE through a sentencepiece model written from the vocabulary.

The model file is serialised here piece by piece: every byte stands for one
character, a token's score is its negative rank, so the best-scored merge is
the lowest rank, and normalisation is the identity. Texts are cut into
pre-tokens first, each is encoded on its own, and decoding maps ids back to
their bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from symptia.llm.common import Vocabulary, documents, pieces_of, text_values

# What splits words off the white space before the merges: Unicode's
# White_Space, of which a single plain space joins the word after it.
SPACE = "\t-\r \x85\xa0  -     　"
RUNS = re.compile(f"([{SPACE}]{{2,}}|[{SPACE.replace(' ', '')}])")
STOPS = (".", ",")
# Distinct words whose ids a task remembers; past it the memory starts anew.
REMEMBERED = 800_000
BATCH_BYTES = 8 << 20
UNKNOWN = "⁇"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def mapped(data: bytes) -> str:
    """One character per byte, none of them a space or a control character."""
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: 256 + b for b in range(256)}


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece ``i + 1`` is the token of
    the i-th lowest rank, piece 0 stands for the unknown and never occurs, as
    every single byte is a piece."""
    ordered = sorted(ranks, key=ranks.get)
    pieces = [_piece(UNKNOWN, 0.0, 2)] + [_piece(mapped(t), -float(ranks[t]), 1) for t in ordered]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(i, -1) for i in (41, 42, 43))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer + _block(45, UNKNOWN.encode())) + _block(3, identity)


class Codec:
    """Encodes texts to ids and decodes ids to bytes.

    A pre-token that is a token as a whole keeps that id, as in tiktoken; in
    vocabularies that come from merges the model gives the same.
    """

    def __init__(self, content: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(content)
        self.ordered = sorted(self.ranks, key=self.ranks.get)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.names = ["", *(str(self.ranks[t]) for t in self.ordered)]
        # tokens that merges do not lead to; none in a vocabulary that was trained
        found = self.pieces.encode([mapped(t) for t in self.ordered], num_threads=1)
        self.unmerged = {t for i, (t, own) in enumerate(zip(self.ordered, found)) if own != [i + 1]}
        self.bytes_of = {str(rank): token for token, rank in self.ranks.items()}
        self.known: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of stretches that no pre-token crosses, as
        decimals with commas. A letter word and a stop or comma after it are
        two pre-tokens, so words share the ids of their letters."""
        known, stopped, mixed, new = self.known, [], {}, set()
        for word in words:
            letters = word[1:] if word[0] == " " else word
            if letters.isalpha():
                new.add(word)
            elif letters[-1:] in STOPS and letters[:-1].isalpha():
                stopped.append(word)
                new.add(word[:-1])
            else:
                mixed[word] = pieces = self.split(word)
                new.update(pieces)
        new.update(STOPS)
        new = [p for p in new if p not in known]
        names, ranks = self.names, self.ranks
        ids = self.pieces.encode([mapped(p.encode()) for p in new], num_threads=1) if new else []
        for piece, own in zip(new, ids):
            known[piece] = names[own[0]] if len(own) == 1 else ",".join([names[i] for i in own])
        for piece in [p for p in new if p.encode() in self.unmerged]:
            known[piece] = str(ranks[piece.encode()])
        for word in stopped:
            known[word] = known[word[:-1]] + "," + known[word[-1]]
        for word, pieces in mixed.items():
            known[word] = ",".join([known[p] for p in pieces])

    def stretches(self, text: str) -> list[str]:
        """Cuts a text where white space makes every pre-token end.

        A run of white space gives all but its last character to one token, a
        last plain space goes to the word after it, and any other last
        character stands alone.
        """
        out: list[str] = []
        parts = RUNS.split(text)
        lead = ""
        for i in range(0, len(parts), 2):
            if i:
                run = parts[i - 1]
                ends = i == len(parts) - 1 and not parts[i]
                head, last = (run, "") if ends else (run[:-1], run[-1])
                lead = " " if last == " " else ""
                out += [x for x in (head, "" if lead else last) if x]
            if parts[i]:
                words = parts[i].split(" ")
                if lead or words[0]:
                    out.append(lead + words[0])
                out += [" " + w for w in words[1:]]
        return out

    def encode_all(self, texts: list[str]) -> list[str]:
        """Per text its decimal ids joined by commas; empty for an empty text."""
        cut = [self.stretches(t) for t in texts]
        words = {w for own in cut for w in own}
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.learn(words - self.known.keys())
        ids = self.known.__getitem__
        return [",".join(map(ids, own)) for own in cut]

    def encode(self, text: str) -> str:
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids (decimals joined by commas), n_tokens and decoded
    (the bytes the ids stand for).

    Null text counts as empty and has no ids; a null doc_id stays null and
    repeated rows are each encoded. Rows stay where they are: no shuffle.
    """
    return _map(docs, vocabulary, pattern, doc_id, text, lambda ids, data: (ids, data),
                "ids string, decoded binary", [("ids", pa.string()), ("decoded", pa.binary())])


def encoding_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 digests in place of the long values."""

    def digests(ids: str, data: bytes) -> tuple[str, str]:
        return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    return _map(docs, vocabulary, pattern, "doc_id", "text", digests, "ids_sha256 string, decoded_sha256 string",
                [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _map(docs, vocabulary, pattern, doc_id, text, derive, columns, fields) -> DataFrame:
    shared = Vocabulary(docs.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        gc.disable()  # nothing here forms cycles, and the remembered words are many
        for batch in pieces_of(batches, BATCH_BYTES):
            codec = codec or Codec(shared.content, pattern)
            counts, derived = [], []
            for ids in codec.encode_all(text_values(batch.column(1))):
                counts.append(ids.count(",") + 1 if ids else 0)
                derived.append(derive(ids, codec.decode(ids)))
            rest = [pa.array(list(c), f[1]) for c, f in zip(zip(*derived) if derived else [[]] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *rest], schema=schema)

    return documents(docs, doc_id, text).mapInArrow(run, f"doc_id long, n_tokens long, {columns}")
