"""BPE encoding and decoding through a table of distinct words.

A scan splits the texts into the words that the tokenizer would encode separately, and packs a few million places at a time
into a chunk: the chunk's distinct words, numbered by how often they occur, and per document the numbers of its words in order.
The distinct words go to buckets by hash, where each different word is encoded once, and their ids return to the chunks, where
they are joined to the places by number. Only distinct words and small numbers travel, never (word, place) pairs. Decoding
joins the ids with the vocabulary's pieces and puts a space between them, as the tokenizers library does for a vocabulary
without a decoder.

The scan runs once for the words and once for the places, over the same splits of the same table, which is written first if docs
is more than a scan of files. Chunks are named, and their
words numbered, by content, so both agree, also when a lost executor's part is made again.

A null text is empty and has no ids. Texts of any length, repeated rows and null ids are rows like any other. The strings of
special tokens become special ids, as in the library. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.common import bucket_count, steady

CHUNK_WORDS = 1 << 21
BLOCK = "chunk long, part int, kind int, payload binary"
WORDS, IDS, PLACES = 0, 1, 2
#: Texts with a character from here on go through the library's own normalizer and splitter; below, NFC changes nothing and str.lower() does what it does.
PLAIN = re.compile(r"[^\u0000-\u017f]")
#: White space as the splitter sees it; Python's own \s would add \x1c to \x1f.
GAP = r"\t-\r \x85\xa0"


def _plain_kind(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: The splitter's pattern for plain texts. Its alternatives start with different characters, so the commonest may come first.
PATTERN = re.compile(rf"[{_plain_kind('L')}]+|[{_plain_kind('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{GAP}{_plain_kind('L')}{_plain_kind('N')}]+")


class Numbers(dict):
    """The number of each word, in the order of their first places."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """The words of a text, so that their encodings one after the other are the text's."""

    def __init__(self, path: str):
        self.lib = tokenizer(path)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def plain(self, text: str) -> list[str]:
        if not PLAIN.search(text):
            return PATTERN.findall(text.lower())
        text = self.lib.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if "<" not in text or not self.special or not self.special.search(text):
            return self.plain(text)
        return [w for i, s in enumerate(self.special.split(text)) for w in ([s] if i % 2 else self.plain(s))]


def _packed(arrays: list[np.ndarray], z) -> bytes:
    return b"".join(len(a).to_bytes(4, "little") for a in arrays) + z.compress(b"".join(a.tobytes() for a in arrays))


def _opened(blob: bytes, kinds: list[str], z) -> list[np.ndarray]:
    lens = [int.from_bytes(blob[4 * i : 4 * i + 4], "little") for i in range(len(kinds))]
    raw, out, at = z.decompress(blob[4 * len(kinds) :]), [], 0
    for n, t in zip(lens, kinds):
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw[at : at + size], t))
        at += size
    return out


def _block(rows: list[tuple]) -> pa.RecordBatch:
    c, p, k, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["chunk", "part", "kind", "payload"])


def _split(path: str, buckets: int, chunk_words: int, kind: int):
    """kind WORDS: a row per chunk and bucket with its words and their numbers; PLACES: rows per chunk with the documents' words as numbers."""

    def run(batches):
        split, z = Splitter(path), zstandard.ZstdCompressor(3)
        number, docs, lens, places, pieces = Numbers(), [], [], [], 0

        def flush():
            flat = np.concatenate(places) if places else np.zeros(0, np.int64)
            words = list(number)
            often = np.bincount(flat, minlength=len(words))
            # chunks of one name have the same words in the same order of frequency, hence the same numbers
            chunk = xxhash.xxh64_intdigest("\n".join(words).encode() + often.tobytes()) >> 1
            # the commonest word is 0; ties by first place, which the split fixes
            order = np.argsort(-often, kind="stable")
            if kind == PLACES:
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                ids = np.array([-1 if d is None else d for d in docs], np.int64)
                null = np.array([d is None for d in docs], np.uint8)
                ends, rows, a = np.cumsum(lens), [], 0
                while a < len(docs):  # about a quarter of a million places a row
                    base = ends[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, base + (1 << 18))))
                    rows.append((chunk, 0, PLACES, _packed([ids[a:b], null[a:b], np.array(lens[a:b], np.uint32), rank[flat[base : ends[b - 1]]]], z)))
                    a = b
                return _block(rows)
            raw = [words[i].encode() for i in order]
            bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in raw], np.int64)
            by, rows = np.argsort(bucket, kind="stable"), []
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for i in range(buckets):
                if (at := by[cuts[i] : cuts[i + 1]]).size:
                    some = [raw[j] for j in at]
                    rows.append((chunk, i, WORDS, _packed([at.astype(np.uint32), np.array([len(w) for w in some], np.uint32), np.frombuffer(b"".join(some), np.uint8)], z)))
            return _block(rows) if rows else None

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split(text.as_py()) if text.is_valid else []
                docs.append(doc)
                lens.append(len(words))
                places.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                pieces += len(words)
                if pieces >= chunk_words:
                    if (out := flush()) is not None:
                        yield out
                    number, docs, lens, places, pieces = Numbers(), [], [], [], 0
        if docs and (out := flush()) is not None:
            yield out

    return run


def _encode(path: str):
    """Each distinct word of a bucket is encoded once; a row per chunk takes its words' ids back."""

    def run(batches):
        lib, zd, zc = tokenizer(path), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(3)
        index, asked = {}, []
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(3)):
                number, lens, raw = _opened(blob.as_py(), ["u4", "u4", "u1"], zd)
                raw, ends = raw.tobytes(), np.cumsum(lens, dtype=np.int64).tolist()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                asked.append((chunk, number, np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))))
        words, flat, count = list(index), [], np.zeros(len(index), np.int64)
        index.clear()
        for at in range(0, len(words), 10_000):
            for i, e in enumerate(lib.encode_batch_fast([w.decode() for w in words[at : at + 10_000]], add_special_tokens=False), at):
                flat.append(np.array(e.ids, np.uint32))
                count[i] = len(flat[-1])
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.cumsum(count) - count
        for chunk, number, at in asked:
            n = count[at]
            yield _block([(chunk, 0, IDS, _packed([number, n.astype(np.uint32), flat[_ranges(starts[at], n)]], zc))])

    return run


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... n[0] numbers; then the same for each next one."""
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(starts - first, n)


def _join(path: str):
    """Rows come sorted by chunk and kind, so a chunk's ids come before its places."""

    def run(batches):
        lib, z = tokenizer(path), zstandard.ZstdDecompressor()
        pieces = [lib.id_to_token(i) for i in range(lib.get_vocab_size(with_added_tokens=True))]
        now, tables, table = None, [], None
        for batch in batches:
            for chunk, kind, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if chunk != now:
                    now, tables, table = chunk, [], None
                if kind == IDS:
                    tables.append(_opened(blob.as_py(), ["u4", "u4", "u4"], z))
                    continue
                if table is None:
                    number, n, flat = (np.concatenate(c) for c in zip(*tables)) if tables else (np.zeros(0, np.int64),) * 3
                    n = n.astype(np.int64)
                    starts, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                    starts[number], count[number] = np.cumsum(n) - n, n
                    table, tables = (starts, count, flat), []
                starts, count, flat = table
                docs, null, lens, at = _opened(blob.as_py(), ["i8", "u1", "u4", "u4"], z)
                ids = flat[_ranges(starts[at], count[at])].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(count[at])])[np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])]
                out, text = [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    out.append(ids[a:b].tobytes())
                    text.append(" ".join([pieces[i] for i in ids[a:b].tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null.astype(bool)), pa.array(np.diff(ends), pa.int64()), pa.array(out, pa.binary()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded."""
    n = bucket_count(docs)
    texts = steady(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    words = texts.mapInArrow(_split(path, n, chunk_words, WORDS), BLOCK)
    places = texts.mapInArrow(_split(path, n, chunk_words, PLACES), BLOCK)
    ids = words.repartitionById(n, F.col("part")).mapInArrow(_encode(path), BLOCK)
    both = ids.unionByName(places).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(_join(path), "doc_id long, n_tokens long, ids binary, decoded string")
