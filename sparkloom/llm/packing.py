"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids (its tokens and one end id) are cut into pieces of MAX_LEN and then, for the rest, into
pieces whose lengths are the powers of two of its binary form, largest first. Each piece is a sequence of
its own. Equal lengths are bucketed: pieces of one length go together to batches of at most BATCH ids, so
that a batch is one full rectangle of ids (`batch_id`, `bucket`: the log2 of its length); a task's last
batch of each length is shorter. Nothing is shuffled: batches hold documents of one task.

A word (a run without white space) is tokenised once and its ids kept, in a table of bounded size: the
tokenizer drops white space, lowers case and splits at white space and between letters and marks, so a
text's ids are those of its words in order, and A-Z may be lowered and a space set before a mark first.
New words of letters alone go to the tokenizer many at a time, with spaces between: each ends with the one id
of its that is marked as a word's last. The table is asked by hashes, and then the bytes of each word are
compared with those that were tokenised; a text with a word that differs goes to the tokenizer whole. So do texts with the separators 0x1C to 0x1F,
on which Python and the tokenizer differ, or with anything like a special token, and all texts if the
tokenizer file does not split as FIXED says.

Cases: a null or empty text has the end id alone (one piece of length 1); repeated rows give their pieces
twice, in sequences of their own; null doc_ids are kept; very long texts are cut like others; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import _MASK, LONG, LOWER, SPACE, blocks, column, eights, runs, word_hashes

MAX_LEN, END = 2048, 1
JOINED = 500  # words that go to the tokenizer as one text
BATCH = 16_384  # ids of a batch, at most
CACHE, CACHE_BYTES = 500_000, 32 << 20  # words whose ids are kept at a time, and the bytes of these words
# How a tokenizer file must normalise and split for words to be tokenised one by one.
FIXED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTER, _MARK, _SPLIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[list(b".,!#$%&*")] = True
_SPLIT[0x1C:0x20] = True
SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, batch_id long, ids binary"


def _plain(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters a to z and of U+00C0 to U+00FF, whatever else they are next to."""
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    first = np.zeros(len(data), bool)
    first[:-1] = second[1:]
    return _LETTER[data] | first | second


class Encoder:
    """Ids of texts by a tokenizers file, with the ids of words kept."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        marks = all(t["content"].startswith("<|") for t in file.get("added_tokens", []))
        self.by_words = marks and file["model"].get("dropout") is None and {k: file.get(k) for k in FIXED} == FIXED
        ends = [i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")] if file["model"].get("end_of_word_suffix") == "</w>" else []
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[ends] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where their ids are
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.spelt, self.spelt_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # bytes of the words, and each one's first

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))

    def _learn(self, keys: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Keep the ids of words of a block, given in the order of their hashes."""
        size = end - start
        at = np.cumsum(size)
        spelt = low[np.arange(at[-1]) + np.repeat(start - at + size, size)]
        raw = spelt.tobytes()
        own = [raw[a:b].decode("utf-8", "replace") for a, b in zip((at - size).tolist(), at.tolist(), strict=True)]
        odd = np.concatenate(([0], np.cumsum(~_plain(spelt))))
        plain = (odd[at] == odd[at - size]) & self.last.any()
        some = [own[i] for i in np.flatnonzero(plain)]
        _, ids = self._ids([" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)])
        lasts = np.flatnonzero(self.last[ids]) + 1
        if len(lasts) != len(some):  # not as thought: one by one
            plain, ids, lasts = np.zeros(len(size), bool), ids[:0], lasts[:0]
        rest, more = self._ids([own[i] for i in np.flatnonzero(~plain)])
        n, first = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        n[plain], n[~plain] = np.diff(lasts, prepend=0), rest
        first[plain], first[~plain] = lasts - n[plain], len(ids) + np.cumsum(rest) - rest
        where = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, where, np.arange(len(self.lengths), len(self.lengths) + len(size)))
        self.keys = np.insert(self.keys, where, keys)
        self.starts = np.concatenate((self.starts, len(self.pool) + first))
        self.lengths = np.concatenate((self.lengths, n))
        self.pool = np.concatenate((self.pool, ids, more))
        self.spelt_at = np.concatenate((self.spelt_at, len(self.spelt) + at))
        self.spelt = np.concatenate((self.spelt, spelt))

    def _same(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each word of a block has the bytes of the table's word at place."""
        begin, size = self.spelt_at[place], end - start
        same = self.spelt_at[place + 1] - begin == size
        mine, known = eights(low), eights(self.spelt)
        live = np.flatnonzero(same & (size <= LONG))
        for step in range(0, LONG, 8):
            live = live[size[live] > step]
            if not len(live):
                break
            mask = _MASK[np.minimum(size[live] - step, 8)]
            same[live] &= (mine[start[live] + step] & mask) == (known[begin[live] + step] & mask)
        for i in np.flatnonzero(same & (size > LONG)):
            same[i] = np.array_equal(low[start[i] : end[i]], self.spelt[begin[i] : begin[i] + size[i]])
        return same

    def _whole(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block (its bytes and offsets)."""
        if not self.by_words:
            return [self._whole(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        low = LOWER[data]
        cut = np.flatnonzero(_LETTER[low[:-1]] & _MARK[low[1:]]) + 1
        start, end, _ = runs(~SPACE[low], np.concatenate((offsets, cut)))
        first = np.searchsorted(start, offsets)
        keys, at, word = np.unique(word_hashes(low, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE or len(self.spelt) > CACHE_BYTES:
            self.clear()
        near = np.searchsorted(self.keys, keys)
        near[near == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], low, start[at[new]], end[at[new]])
        place = self.slot[np.searchsorted(self.keys, keys)][word]
        n = self.lengths[place]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(self.starts[place] - before[:-1], n) + np.arange(before[-1])]
        out = [ids[a:b] for a, b in zip(before[first[:-1]], before[first[1:]], strict=True)]
        odd = np.flatnonzero(_SPLIT[data])
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        other = start[~self._same(low, start, end, place)]  # words of another's hash
        for i in np.unique(np.searchsorted(offsets, np.concatenate((odd, special, other)), "right") - 1):
            out[i] = self._whole(data[offsets[i] : offsets[i + 1]].tobytes())
        return out


def pieces(n: int) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    rest = n % MAX_LEN
    return [MAX_LEN] * (n // MAX_LEN) + [1 << k for k in range(MAX_LEN.bit_length() - 2, -1, -1) if rest >> k & 1]


_encoders: dict[str, Encoder] = {}


def _packer(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        waiting: list[list[tuple]] = [[] for _ in range(MAX_LEN.bit_length())]  # pieces of each length, fewer than a batch
        made = TaskContext.get().partitionId() << 40

        def full(bucket: int) -> pa.RecordBatch:
            nonlocal made
            rows, waiting[bucket] = waiting[bucket], []
            doc, at, total, raw = zip(*rows, strict=True)
            n = len(rows)
            cols = [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(np.full(n, 1 << bucket)), pa.array(np.full(n, bucket, np.int32)), pa.array(total, pa.int64()), pa.array(np.full(n, made)), pa.array(raw, pa.binary())]
            made += 1
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for lo, hi, data, offsets in blocks(column(batch, "text"), 1 << 20):
                for doc, got in zip(ids[lo:hi], encoder.encode(data, offsets), strict=True):
                    raw = np.append(got, END).astype("<u4").tobytes()
                    total, at = len(raw) // 4, 0
                    for n in pieces(total):
                        bucket = n.bit_length() - 1
                        waiting[bucket].append((doc, at, total, raw[4 * at : 4 * (at + n)]))
                        if len(waiting[bucket]) << bucket >= BATCH:
                            yield full(bucket)
                        at += n
        for bucket, rows in enumerate(waiting):
            if rows:
                yield full(bucket)

    return pack


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) with their ids (little-endian unsigned 32-bit), bucket (log2 of the length), batch_id
    and sequence_id (unique, not gapless); each piece fills its sequence from offset 0. Nothing is shuffled."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    common.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.freeing(_packer(str(tokenizer))), SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
