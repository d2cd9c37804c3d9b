"""Byte-pair encoding and decoding over a table of distinct words.

Texts are split into words by the tokenizer's own rules (composition, lower
case, contractions, runs of letters, single digits, runs of other marks;
special tokens in a text stay whole). The texts of a task form blocks of
bounded size; a block keeps its texts as positions in its list of words. The
words of all blocks meet by hash, so each distinct word is encoded once, and
its ids go back to the blocks that use it, where positions become ids. Decoding
joins ids to pieces (the vocabulary, of fixed size) and strings pieces
together in order. Texts are never shuffled, only packed positions.

The tokenizer must be a word-level BPE in the ``tokenizers`` JSON format: with
no decoder (pieces are joined by spaces), and a pre-tokenizer that splits by
a pattern and then maps bytes.

Defined cases: NULL text counts as empty and gives no ids; a word of any
length is one row; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import fields, list_array, slices, stage_derived

#: Bytes of text in a block, and (block, word) rows in a group of words.
BLOCK_BYTES = 32 << 20
GROUP_WORDS = 200_000

#: White space of the tokenizer's pattern language.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


class WordTokenizer:
    """What the tasks need of a tokenizer file: splitting, word ids, pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = split.replace(r"[^\s", "[^" + _SPACE)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = sorted([*spec["model"]["vocab"].items(), *self.special.items()], key=lambda kv: kv[1])
        # words arrive split and lower-cased, so only the byte map and the merges remain
        inner = {**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}
        self.inner = json.dumps(inner)
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _tools(self):
        if self._ready is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
            pieces = [""] * (1 + max(i for _, i in self.pieces))
            for piece, i in self.pieces:
                pieces[i] = piece
            self._ready = (regex.compile(self.pattern), marks, Tokenizer.from_str(self.inner), pieces)
        return self._ready

    def split(self, text: str) -> list[str]:
        """Words of a text in order; special tokens as they stand."""
        words, marks = self._tools()[:2]
        parts = marks.split(text) if marks and "<" in text else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                # every capital sigma has one small form here, also at a word's end
                out += words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        tool = self._tools()[2]
        plain = tool.encode_batch_fast(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, plain)]

    def piece_list(self) -> list[str]:
        return self._tools()[3]


def _pack(values: np.ndarray) -> bytes:
    """32-bit values by byte plane, compressed."""
    planes = np.ascontiguousarray(values, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


class _Block:
    """Texts gathered in one task until they reach the block size."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.known: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, text: str, words: list[str]) -> None:
        known = self.known
        self.places.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.bytes += len(text)

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        """Positions by falling frequency of their words; words by bucket."""
        flat = np.concatenate(self.places)
        order = np.argsort(-np.bincount(flat, minlength=len(self.known)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode() for w in self.known]
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], dtype=np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        used, cuts = np.unique(bucket[by_bucket], return_index=True)
        packed = []
        for b, members in zip(used.tolist(), np.split(by_bucket, cuts[1:])):
            own = sorted(members.tolist(), key=words.__getitem__)
            packed.append({"bucket": b, "ranks": _pack(rank[own]), "words": zstandard.compress(b"\n".join(words[i] for i in own), 3)})
        return fields(
            ["block", "doc_ids", "lengths", "places", "sets"],
            [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                list_array([np.array(self.lengths)], pa.int32()),
                pa.array([_pack(rank[flat])], pa.binary()),
                pa.array([packed], pa.list_(_SET)),
            ],
        )


_SET = pa.struct([("bucket", pa.int64()), ("ranks", pa.binary()), ("words", pa.binary())])


def text_blocks(docs: DataFrame, tokenizer: WordTokenizer, buckets: int) -> DataFrame:
    """One row per block: ids, word counts and positions of its texts, and its words by bucket."""

    def work(batches):
        part, count, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, text or "", tokenizer.split(text or ""))
                if block.bytes >= BLOCK_BYTES:
                    yield block.row((part << 32) | count, buckets)
                    count, block = count + 1, _Block()
        if block.ids:
            yield block.row((part << 32) | count, buckets)

    schema = (
        "block long, doc_ids array<long>, lengths array<int>, places binary, "
        "sets array<struct<bucket: long, ranks: binary, words: binary>>"
    )
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def encoded_words(blocks: DataFrame, tokenizer: WordTokenizer) -> DataFrame:
    """The ids of every block's words; each distinct word is encoded once.

    A bucket holds every block's words of one hash range; the number of
    buckets grows with the text, so a bucket's size does not.
    """

    def work(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(w).decode().split("\n") for w in table["words"].to_pylist()]
        distinct = list({w: None for words in lists for w in words})
        ids: dict[str, np.ndarray] = {}
        for start in range(0, len(distinct), 10_000):
            part = distinct[start : start + 10_000]
            ids.update(zip(part, (np.array(i, dtype=np.uint32) for i in tokenizer.encode(part))))
        sizes, values = [], []
        for words in lists:
            own = [ids[w] for w in words]
            sizes.append(_pack(np.array([len(i) for i in own])))
            values.append(_pack(np.concatenate(own)))
        return pa.table({
            "block": table["block"], "ranks": table["ranks"],
            "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(values, pa.binary()),
        })

    sets = blocks.select("block", F.explode("sets").alias("s")).select("block", "s.bucket", "s.ranks", "s.words")
    return sets.groupBy("bucket").applyInArrow(work, "block long, ranks binary, sizes binary, ids binary")


def _joined(blocks: pa.Table, words: pa.Table, pieces: list[str]) -> tuple[list, list, list, list]:
    """Ids and pieces of a block's words, put back at every position."""
    total = sum(len(_unpack(r)) for r in words["ranks"].to_pylist())
    size, id_text, piece_text = np.zeros(total, dtype=np.int64), [""] * total, [""] * total
    for ranks, sizes, ids in zip(*(words[c].to_pylist() for c in ("ranks", "sizes", "ids"))):
        ranks, sizes, ids = _unpack(ranks), _unpack(sizes), _unpack(ids).tolist()
        size[ranks] = sizes
        start = 0
        for rank, n in zip(ranks.tolist(), sizes.tolist()):
            own = ids[start : start + n]
            id_text[rank] = " ".join(map(str, own))
            piece_text[rank] = " ".join([pieces[i] for i in own])
            start += n
    out: tuple[list, list, list, list] = ([], [], [], [])
    hollow = bool((size == 0).any())  # words without ids leave no space behind
    for ids, lengths, places in zip(*(blocks[c].to_pylist() for c in ("doc_ids", "lengths", "places"))):
        at, start = _unpack(places), 0
        for doc_id, n in zip(ids, lengths):
            own = at[start : start + n]
            start += n
            if hollow:
                own = own[size[own] > 0]
            tokens = int(size[own].sum())
            own = own.tolist()
            out[0].append(doc_id)
            out[1].append(tokens)
            out[2].append(hashlib.sha256(" ".join([id_text[p] for p in own]).encode()).hexdigest())
            out[3].append(hashlib.sha256(" ".join([piece_text[p] for p in own]).encode()).hexdigest())
    return out


def buckets_for(docs: DataFrame) -> int:
    """Number of word buckets, in proportion to the characters of all texts."""
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    # about one (block, word) row per 80 characters in blocks of 32 MB
    return max(8, int(chars / 80 / GROUP_WORDS) + 1)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of ids and decoded text of every row."""
    tokenizer = WordTokenizer(path)
    blocks = stage_derived(text_blocks(docs, tokenizer, buckets_for(docs)))
    words = encoded_words(blocks, tokenizer)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = _joined(left, right, tokenizer.piece_list())
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = blocks.select("block", "doc_ids", "lengths", "places")
    joined = texts.groupBy("block").cogroup(words.groupBy("block"))
    return joined.applyInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
