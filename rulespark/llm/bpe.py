"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in blocks of bounded size.  A block numbers its
distinct words in the order in which they come and keeps, for each text, the
numbers of its words by position.  The words of all blocks are dealt out by
word, and each distinct word is encoded once; its ids go back to the blocks it
came from.  There the ids are joined to the positions, and an id-to-piece table
gives the decoded text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import map_arrow, release_memory

#: Characters of text after which a block ends (a longer text is a block of its own).
BLOCK_CHARS = 32 << 20

# Fixed values of the vocabulary's format: how a text splits into words, and the special tokens.
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
WORDS = regex.compile(r"\p{L}+|\p{N}|" + CONTRACTIONS + r"|[^\p{White_Space}\p{L}\p{N}]+")

# The same for texts of ASCII and of Latin letters that no normal form changes.
LATIN_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|" + CONTRACTIONS + r"|[^ \t-\ra-z0-9ß-öø-ÿ]+")
NOT_LATIN = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")

#: A special token in a text is one word, told from ordinary ones by this first character (no word has white space).
SPECIAL = "\n"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=1)
def byte_signs() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1 bytes are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = [""] * 256
    others = iter(range(256, 512))
    for b in range(256):
        signs[b] = chr(b) if b in own else chr(next(others))
    return signs


def split_words(text: str, path: str) -> list[str]:
    """The words of a text as the vocabulary's normaliser and splitter give them."""
    marks = specials(path)
    if "<" in text and any(m in text for m in marks):
        out: list[str] = []
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")", text)):
            out += [SPECIAL + part] if k % 2 else split_words(part, path) if part else []
        return out
    if text.isascii() or not NOT_LATIN.search(text):
        return LATIN_WORDS.findall(text.lower())
    return WORDS.findall(tokenizer(path).normalizer.normalize_str(text))


def encode_word(word: str, path: str) -> list[int]:
    """The ids of one word."""
    if word[0] == SPECIAL:
        return [specials(path)[word[1:]]]
    signs = byte_signs()
    return [t.id for t in tokenizer(path).model.tokenize("".join([signs[b] for b in word.encode()]))]


class _Block:
    """Numbers words in the order in which they come, and holds the numbers of each text."""

    def __init__(self):
        self.names: defaultdict[str, int] = defaultdict()
        self.names.default_factory = self.names.__len__
        self.ids: list = []
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, words: list[str], chars: int) -> None:
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.names.__getitem__, words), np.uint32, len(words)))
        self.chars += chars

    def key(self) -> int:
        """A name for the block that its words in order decide."""
        digest = hashlib.blake2b("\0".join(self.names).encode("utf-8", "surrogatepass"), digest_size=8)
        return int.from_bytes(digest.digest(), "little", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py() or ""
            block.add(batch.column(0)[k].as_py(), split_words(text, path), len(text))
            if block.chars >= BLOCK_CHARS:
                yield block
                block = _Block()
    if block.ids:
        yield block


def pack(codes: list[np.ndarray]) -> bytes:
    """The numbers of several texts, byte by byte in planes, compressed plane by plane so that no second copy is held."""
    out = zstandard.ZstdCompressor(level=3).compressobj(size=4 * sum(map(len, codes)))
    parts = []
    for k in range(4):
        parts += [out.compress(np.ascontiguousarray(c.view(np.uint8)[k::4]).tobytes()) for c in codes]
    return b"".join([*parts, out.flush()])


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    out = np.empty((planes.shape[1], 4), np.uint8)
    for k in range(4):
        out[:, k] = planes[k]
    return out.view(np.uint32).ravel()


def _block_words(path: str):
    """(doc_id, text) to (block, size, number, word): the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, path):
            key, names = block.key(), list(block.names)
            size = len(names)
            for at in range(0, size, 20_000):
                part = names[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.string())], names=["block", "number", "word"]
                )

    return run


def _block_texts(path: str):
    """(doc_id, text) to (block, words, doc_ids, lengths, codes): one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.key()], pa.int64()),
                    pa.array([len(block.names)], pa.int32()),
                    pa.array([block.ids], pa.list_(pa.int64())),
                    pa.array([[len(c) for c in block.codes]], pa.list_(pa.int32())),
                    pa.array([pack(block.codes)], pa.binary()),
                ],
                names=["block", "words", "doc_ids", "lengths", "codes"],
            )

    return run


def _encode(path: str):
    """Rows sorted by word: each distinct word is encoded once, each row gets its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for batch in batches:
            out = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, np.array(encode_word(word, path), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "number", "ids"])

    return run


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces as bytes, each with a space after it, and their offsets."""
    own = tokenizer(path)
    count = own.get_vocab_size(with_added_tokens=True)
    parts = [((own.id_to_token(i) or "") + " ").encode() for i in range(count)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _gather(values: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[c]:offsets[c + 1]]`` of each chosen c, and the offsets of the runs in them."""
    size = (offsets[1:] - offsets[:-1])[chosen]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offsets[:-1][chosen] - out[:-1], size) + np.arange(out[-1])], out


def _join_ids(path: str, carry_ids: bool):
    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        number = words.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = number[order][1:] != number[order][:-1]  # blocks with the same words share a key
        order = order[new]
        runs = words.column("ids").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        _, where, data = runs.buffers()
        ids = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, "<u4")
        at = np.frombuffer(where, np.int64)[: len(runs) + 1] // 4
        letters, cut = pieces(path)
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for row in texts.to_pylist():
            if row["words"] != len(order):
                raise RuntimeError("the texts changed between two scans; checkpoint them first")
            codes, start = unpack(row["codes"]), 0
            for doc_id, length in zip(row["doc_ids"], row["lengths"]):
                own = _gather(ids, at, codes[start : start + length])[0]
                start += length
                text = _gather(letters, cut, own)[0][:-1]
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(own.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.tobytes()).hexdigest())
                out["ids"].append(own if carry_ids else None)
        return pa.table(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "ids_sha256": pa.array(out["ids_sha256"], pa.string()),
                "decoded_sha256": pa.array(out["decoded_sha256"], pa.string()),
                **({"ids": pa.array(out["ids"], pa.list_(pa.int64()))} if carry_ids else {}),
            }
        )

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        try:
            return join(texts, words)
        finally:
            release_memory()

    return run


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also the ids.

    ``path`` is a tokenizers file of the kind with word ends, present on every
    machine.  The ids are those of encode(text, add_special_tokens=False)
    without truncation or padding; the decoded text is that of decode(ids,
    skip_special_tokens=False).  The digests are of the ids as little-endian
    32-bit integers and of the decoded text in UTF-8.

    Null and empty texts, and those of white space, have no token.  A null id
    stays null, a repeated row gives a repeated result, other columns are
    ignored, and an empty table gives an empty result.  ``docs`` is scanned
    twice and has to give the same rows both times, as stored tables do; if it
    doesn't, the run fails.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = texts.transform(map_arrow, _block_words(path), "block long, number int, word string")
    encoded = words.repartition("word").sortWithinPartitions("word").transform(map_arrow, _encode(path), "block long, number int, ids binary")
    blocks = texts.transform(map_arrow, _block_texts(path), "block long, words int, doc_ids array<long>, lengths array<int>, codes binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_join_ids(path, with_ids), schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of each row's ids, null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, cut = pieces(path)
        at = encoded_names.index(ids_col)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            text = [None if x is None else _gather(letters, cut, np.array(x, np.int64))[0][:-1].tobytes().decode() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*encoded_names, "decoded"])

    encoded_names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.transform(map_arrow, run, schema + ", decoded string")
