"""Byte-level BPE by the tokenizers library, over Arrow batches, and back.

A text is cut at the matches of the vocabulary's pattern; each match is encoded by itself, every distinct
one once per task. A vocabulary file writes each byte as a printable character; undoing
that table gives the bytes of every token, hence byte offsets of tokens and, through
the positions of continuation bytes, character offsets. A character may be split over
tokens: all of them get its position as their start, and `split` tells how many such tokens there are.

A missing text counts as empty and gives no tokens. Ids outside the vocabulary decode to nothing.
Decoding gives the exact bytes; as text, bytes that form no character become U+FFFD. Texts of any length are encoded whole. Rows are
handled one by one, repeated ones alike, whatever their ids; an empty table gives no rows. Columns named like the added ones are replaced,
all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import fields, slices, text_or_empty, with_columns, without

# Distinct matches remembered by a task; beyond it, the memory starts anew.
REMEMBERED = 200_000
# Texts above this many characters are cut piece by piece.
LONG_TEXT = 1 << 20


def byte_characters() -> dict[str, int]:
    """Printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def _tokenizer(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; special tokens stand for their name."""
    tokenizer, table = _tokenizer(path), byte_characters()
    found = [b""] * (1 + max(tokenizer.get_vocab().values()))
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items()}
    for token, i in tokenizer.get_vocab().items():
        found[i] = token.encode() if i in special else bytes(table[c] for c in token)
    return found


def _encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit integers."""
    import regex

    tokenizer, cut = _tokenizer(path), regex.compile(pattern)
    known: dict[str, bytes] = {}

    def learn(matches: list[str]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        new = [m for m in {*matches} if m not in known]
        for match, encoding in zip(new, tokenizer.encode_batch(new, add_special_tokens=False)):
            known[match] = np.array(encoding.ids, "<u4").tobytes()

    def joined(matches: list[str]) -> bytes:
        try:
            return b"".join([known[m] for m in matches])
        except KeyError:
            learn(matches)
            return b"".join([known[m] for m in matches])

    def pieces(text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield cut.findall(text)
            return
        matches = cut.finditer(text)
        while part := [m.group() for m in islice(matches, LONG_TEXT >> 3)]:
            yield part

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join([joined(part) for part in pieces(text)]) for text in texts]

    return encode


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids (binary, little-endian unsigned 32-bit integers) and n_tokens."""

    def compute() -> Callable[[list[str]], list]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(vocabulary, pattern)

        def columns(texts: list[str]) -> list:
            ids = encode(texts)
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

        return columns

    return with_columns(df, text, "ids binary, n_tokens bigint", compute)


def character_starts(tokens: list[bytes]) -> tuple[list[int], int]:
    """For each token the character in which it begins, and how many tokens cut a character."""
    data = np.frombuffer(b"".join(tokens), np.uint8)
    lead = (data & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    starts = ends - [len(t) for t in tokens]
    whole = np.append(lead, True)
    split = ~whole[starts] | ~whole[ends] if tokens else np.zeros(0, bool)
    return np.maximum(np.append(character, character[-1:] + 1)[starts], 0).tolist() if tokens else [], int(split.sum())


def _from_ids(df: DataFrame, vocabulary: str, added: str, columns: Callable[[list[list[bytes]]], list]) -> DataFrame:
    names = [part.split()[0] for part in added.split(",")]
    source = without(df, *names)
    position, kept = [c.lower() for c in source.columns].index("ids"), source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        size = len(table)
        for part in slices(batches):
            rows = []
            for packed in part.column(position).to_pylist():
                ids = np.frombuffer(packed or b"", "<u4")
                rows.append([table[i] for i in ids[ids < size].tolist()])
            yield pa.RecordBatch.from_arrays([*part.columns, *columns(rows)], [*kept, *names])

    return source.mapInArrow(run, f"{fields(source)}, {added}")


def token_offsets(df: DataFrame, vocabulary: str) -> DataFrame:
    """``df``, which has ids, with starts (the character in which each token begins) and split."""

    def columns(rows: list[list[bytes]]) -> list:
        found = [character_starts(row) for row in rows]
        return [pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())]

    return _from_ids(df, vocabulary, "starts array<int>, split bigint", columns)


def decode_ids(df: DataFrame, vocabulary: str) -> DataFrame:
    """``df``, which has ids, with decoded (binary) and decoded_text."""

    def columns(rows: list[list[bytes]]) -> list:
        decoded = [b"".join(row) for row in rows]
        return [pa.array(decoded, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]

    return _from_ids(df, vocabulary, "decoded binary, decoded_text string", columns)


def document_tokens(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The contract's digests of ids and of decoded bytes."""
    texts = documents.select("doc_id", text_or_empty().alias("text"))
    decoded = decode_ids(encode_texts(texts, vocabulary, pattern).select("doc_id", "ids", "n_tokens"), vocabulary)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
