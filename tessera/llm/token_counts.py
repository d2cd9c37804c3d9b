"""Token counts of whole texts without their ids.

A byte-level BPE cuts a text into pre-tokens by one pattern, and a pre-token's
number of pieces depends on nothing else. So a text's count is the sum, over its
distinct pre-tokens, of frequency times pieces:

1. Texts of a task form blocks of bounded size. A block keeps, per text, the
   frequencies of its pre-tokens as positions in the block's own list.
2. The lists of all blocks meet by hash of the pre-token; there each distinct
   one is counted once, however many blocks hold it.
3. The counts return to their block, where frequency times pieces is summed.

Texts are read once and never shuffled, ids of whole texts are never made. A
very frequent pre-token is one entry per block, not one per text.

The tokenizer must be a byte-level BPE in the ``tokenizers`` JSON format that
splits by the usual pattern and has no normaliser; others are refused. Strings
of special tokens inside a text count as one token each, as that library does
unless told otherwise.

Defined cases: NULL text counts as empty (0 bytes, 0 tokens); a NULL id stays
NULL; repeated rows give repeated results; a text or pre-token of any length is
counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.common import fields, list_array, slices, stage_derived

#: Bytes of text in a block; (block, pre-token) entries that meet in one group.
BLOCK_BYTES = 16 << 20
GROUP_WORDS = 200_000
#: Texts with more tokens than this are over the limit.
LIMIT = 1024

#: The white space of the tokenizer's pattern language.
WIDE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = r"\t-\r\x20" + "".join(rf"\U{c:08x}" for c in WIDE_SPACE)
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, *WIDE_SPACE)))
#: Letters, numbers and marks with at most one space before them, contractions, white space. Letters come first
#: since most pre-tokens are words; no other branch can start like one, so the order changes nothing.
PATTERN = (
    r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


#: Marks that end a word without joining anything behind it.
STOPS = frozenset(".,;:!?")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)  # one for each tokenizer that a worker process meets
def _tools(model: str, special: tuple[str, ...]):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    between = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
    own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return marks, regex.compile(PATTERN).findall, between.split, own, Tokenizer.from_str(model).model


LETTERS = byte_letters()


class PieceCounter:
    """What tasks need of a tokenizer file: pre-tokens of a text, pieces of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or not plain:
            raise ValueError(f"{path} is no byte-level BPE without a normaliser")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.model = json.dumps({"version": spec["version"], "added_tokens": [], "model": spec["model"]})
        self._ready = None
        self._sure: set[str] = set()

    def __getstate__(self):
        return self.__dict__ | {"_ready": None, "_sure": set()}

    def _tools(self):
        if self._ready is None:
            self._ready = _tools(self.model, tuple(self.special))
        return self._ready

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of a text between special tokens, and those tokens (marked)."""
        marks = self._tools()[0]
        if marks is None or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        return [(p, p in self.special) for p in marks.split(text) if p]

    def sure(self, letters: set[str]) -> bool:
        """Whether Python knows all these code points.

        Later ones may be letters to one library and not to the other, so
        texts with them are left to the tokenizer's own splitting.
        """
        new = letters - self._sure
        known = {c for c in new if unicodedata.category(c) != "Cn"}
        self._sure |= known
        return len(known) == len(new)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.sure(set(text)):
            return self._tools()[1](text)
        return [text[a:b] for _, (a, b) in self._tools()[3](text)]

    def chunks(self, text: str, letters: set[str]) -> list[str]:
        """A stretch cut at every single space between two marks.

        The pattern always starts a pre-token at such a space, so chunks can be
        counted first and cut into pre-tokens once per distinct chunk. The
        space is left out; all chunks but the first begin with one.
        """
        wide = letters & WHITE
        ragged = text[0] == " " or text[-1] == " " or any(w + " " in text or " " + w in text for w in wide)
        return self._tools()[2](text) if ragged else text.split(" ")

    def pieces(self, words: list[str]) -> list[int]:
        tokenize, special = self._tools()[4].tokenize, set(self.special)
        return [1 if w in special else len(tokenize(w.encode().decode("latin-1").translate(LETTERS))) for w in words]


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values by byte plane, compressed."""
    planes = np.ascontiguousarray(values, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


class _Block:
    """Chunk counts of the texts gathered in one task until they reach the block size."""

    def __init__(self, counter: PieceCounter):
        self.counter = counter
        self.ids: list = []
        self.sizes: list[int] = []
        self.words: dict[str, int] = {}
        self.first: dict[str, int] = {}  # chunks that begin a stretch
        self.later: dict[str, int] = {}  # chunks after a space
        self.flat: list[int] = []  # pre-tokens of all chunks in turn
        self.lengths: list[int] = []  # their number by chunk
        self.seen: list[np.ndarray] = []
        self.bytes = 0

    def _place(self, words: list[str]) -> int:
        known = self.words
        self.flat += [known.setdefault(w, len(known)) for w in words]
        self.lengths.append(len(words))
        return len(self.lengths) - 1

    def _cut(self, chunk: str, sure: bool) -> list[str]:
        """Pre-tokens of a chunk behind its space; most chunks are one word, or a word and a stop."""
        if sure and chunk.isalpha():
            return [" " + chunk]
        if sure and chunk[-1:] in STOPS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.counter.words(" " + chunk)

    def add(self, doc_id, text: str) -> None:
        letters = set(text)
        sure = self.counter.sure(letters)
        first, later = self.first, self.later
        chunks: list[int] = []
        counts: list[int] = []
        for part, special in self.counter.parts(text):
            head, *rest = [part] if special else self.counter.chunks(part, letters)
            if head not in first:
                first[head] = self._place([head] if special else self.counter.words(head))
            found = Counter(rest)
            at = [first[head], *map(later.get, found)]
            if None in at:
                for i, chunk in enumerate(found, 1):
                    if at[i] is None:
                        at[i] = later[chunk] = self._place(self._cut(chunk, sure))
            chunks += at
            counts += [1, *found.values()]
        size = len(text.encode())
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.seen.append(np.array([chunks, counts], dtype=np.int32))
        self.bytes += size

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        """Frequencies by position in the block's list, which stands bucket by bucket."""
        words = [w.encode() for w in self.words]
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], dtype=np.int64)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        sets = []
        used, cuts = np.unique(bucket[order], return_index=True)
        for b, start, end in zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            own = [words[i] for i in order[start:end].tolist()]
            lengths = _pack(np.array([len(w) for w in own]))
            sets.append({"bucket": b, "start": start, "lengths": lengths, "words": zstandard.compress(b"".join(own), 3)})
        texts, places, counts = self._frequencies(place)
        n_words = np.bincount(texts, minlength=len(self.ids))
        steps = np.diff(places, prepend=0)
        begins = np.cumsum(n_words) - n_words
        begins = begins[n_words > 0]
        steps[begins] = places[begins]
        return fields(
            ["block", "doc_ids", "sizes", "n_words", "places", "counts", "sets"],
            [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                list_array([np.array(self.sizes)], pa.int64()),
                list_array([n_words], pa.int64()),
                pa.array([_pack(steps)], pa.binary()),
                pa.array([_pack(counts)], pa.binary()),
                pa.array([sets], pa.list_(_SET)),
            ],
        )

    def _frequencies(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, place and frequency of every pre-token of every text, in that order."""
        chunk = np.concatenate([s[0] for s in self.seen])
        count = np.concatenate([s[1] for s in self.seen])
        text = np.repeat(np.arange(len(self.seen)), [s.shape[1] for s in self.seen])
        length, flat = np.array(self.lengths or [0], dtype=np.int64), np.array(self.flat, dtype=np.int64)
        start = np.cumsum(length) - length
        each = length[chunk]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        places = place[flat[np.repeat(start[chunk], each) + inside]] if len(flat) else np.empty(0, dtype=np.int64)
        width = max(1, len(place))
        keys, where = np.unique(np.repeat(text, each) * width + places, return_inverse=True)
        counts = np.bincount(where, weights=np.repeat(count, each), minlength=len(keys)).astype(np.int64)
        return keys // width, keys % width, counts


_SET = pa.struct([("bucket", pa.int64()), ("start", pa.int64()), ("lengths", pa.binary()), ("words", pa.binary())])
_BLOCKS = (
    "block long, doc_ids array<long>, sizes array<long>, n_words array<long>, places binary, counts binary, "
    "sets array<struct<bucket: long, start: long, lengths: binary, words: binary>>"
)


def frequency_blocks(docs: DataFrame, counter: PieceCounter, buckets: int) -> DataFrame:
    """One row per block: pre-token frequencies of its texts, and its pre-tokens by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, _Block(counter)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, text or "")
                if block.bytes >= BLOCK_BYTES:
                    yield block.row((part << 32) | number, buckets)
                    number, block = number + 1, _Block(counter)
        if block.ids:
            yield block.row((part << 32) | number, buckets)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, _BLOCKS)


def piece_counts(blocks: DataFrame, counter: PieceCounter) -> DataFrame:
    """Pieces of every block's pre-tokens; each distinct pre-token is encoded once."""

    def work(rows: pa.Table) -> pa.Table:
        lists = []
        for lengths, packed in zip(rows["lengths"].to_pylist(), rows["words"].to_pylist()):
            ends, whole = np.cumsum(_unpack(lengths)).tolist(), zstandard.decompress(packed)
            lists.append([whole[a:b].decode() for a, b in zip([0, *ends], ends)])
        distinct = list({w: None for words in lists for w in words})
        known: dict[str, int] = {}
        for start in range(0, len(distinct), 10_000):
            part = distinct[start : start + 10_000]
            known.update(zip(part, counter.pieces(part)))
        packed = [_pack(np.array([known[w] for w in words])) for words in lists]
        return pa.table({"block": rows["block"], "start": rows["start"], "pieces": pa.array(packed, pa.binary())})

    sets = blocks.select("block", F.explode("sets").alias("s")).select("block", "s.*")
    return sets.groupBy("bucket").applyInArrow(work, "block long, start long, pieces binary")


def _sums(blocks: pa.Table, counts: pa.Table, limit: int) -> pa.Table:
    """Frequency times pieces of one block, summed by text."""
    by_start = sorted(zip(counts["start"].to_pylist(), counts["pieces"].to_pylist()))
    pieces = np.concatenate([np.empty(0, dtype=np.int64), *[_unpack(p) for _, p in by_start]])
    out = []
    for row in blocks.to_pylist():
        n_words = np.array(row["n_words"], dtype=np.int64)
        steps = _unpack(row["places"])
        ends = np.cumsum(steps)
        first = np.cumsum(n_words) - n_words
        base = np.zeros(len(n_words), dtype=np.int64)
        some = n_words > 0
        base[some] = ends[first[some]] - steps[first[some]]
        places = ends - np.repeat(base, n_words)
        text = np.repeat(np.arange(len(n_words)), n_words)
        tokens = np.zeros(len(n_words), dtype=np.int64)
        np.add.at(tokens, text, pieces[places] * _unpack(row["counts"]))
        out.append(pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["sizes"], pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit, pa.bool_()),
        }))
    return pa.concat_tables(out) if out else _NONE


_NONE = pa.table({
    "doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
    "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_()),
})


def groups_for(docs: DataFrame) -> int:
    """Number of pre-token groups, in proportion to the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0
    # about one (block, pre-token) entry per 60 bytes of text in blocks of 16 MB
    return max(8, int(size / 60 / GROUP_WORDS) + 1)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row (two eager jobs)."""
    counter = PieceCounter(path)
    blocks = stage_derived(frequency_blocks(docs, counter, groups_for(docs)))
    texts = blocks.select("block", "doc_ids", "sizes", "n_words", "places", "counts")
    joined = texts.groupBy("block").cogroup(piece_counts(blocks, counter).groupBy("block"))
    return joined.applyInArrow(
        lambda own, counts: _sums(own, counts, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
