"""Harmonic packing of token sequences.

With capacity C, class j holds the lengths in (C/(j+1), C/j], and a bin of class j takes j of
them. As documents may be cut, every piece gets the largest length of its class, C // j: whole
bins first, and the rest in the fewest pieces (a change-making table). A bin of class j is
then j equal pieces, so a worker places a piece from its rank in the class alone: ranks are a
count before its chunk plus the rank in it, and no piece sees another. What is left of each class,
fewer than j pieces and so bounded by C alone, is dealt out best-fit from the counts.

Documents are cut freely: the more exact the lengths, the less padding. README gives the figures beside those of whole documents.

Defined cases: a null or empty text is its end id alone; a text of any length is worked on whole, and its pieces follow each other
in start; repeated rows are packed once each; among pieces of a length, the order of rows in a task decides; an empty table gives no pieces.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_pandas, pick, settle, table

CAPACITY = 2048
END_ID = 1
END = struct.pack("<I", END_ID)
#: Chunks and words kept a worker, in each of two generations; longer ones than KEPT_LENGTH aren't kept.
CACHE, KEPT_LENGTH = 500_000, 64
#: Characters split at a time; a longer text is split a part at a time.
GROUP = 8_000_000

#: The tokenizer files whose words can be worked on one by one, and how they split lower-cased text, over the characters of PLAIN.
#: No word holds white space, and a chunk of letters alone is one word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACE = re.compile("[\t\n\r ]")
PLAIN = re.compile("[\t\n\r -~¡-ÿ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")


#: Bytes that end a word before one of OPENING; an apostrophe may go on as 's.
LETTER = np.array([chr(b) in string.ascii_lowercase for b in range(256)])
OPENING = np.array([chr(b) in string.punctuation and chr(b) != "'" for b in range(256)])


def apart(lower: list[str]) -> pa.LargeStringArray:
    """The texts with a space between a letter of a to z and a sign, so that most chunks are words."""
    texts = pa.array(lower, pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(lower) + 1)
    data = np.frombuffer(data or b"", np.uint8, offsets[-1])
    at = np.flatnonzero(LETTER[data[:-1]] & OPENING[data[1:]]) + 1
    offsets, data = offsets + np.searchsorted(at, offsets), np.insert(data, at, ord(" "))
    return pa.LargeStringArray.from_buffers(len(lower), pa.py_buffer(offsets), pa.py_buffer(data))


def parts(text: str, size: int) -> Iterator[str]:
    """The text cut before white space, in parts that take the first place from `size` characters on."""
    start = 0
    while found := SPACE.search(text, start + size):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Ids of texts, four bytes each.

    Texts over PLAIN are split at white space, many at once, and each distinct chunk is looked up once. Words of chunks that aren't known go to the tokenizer's model,
    all in one call. Other texts, texts that hold an added token, and all texts of tokenizers that split otherwise go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        self.by_word = self._splits_as_known(form) and self._ends_are_known(form["model"], pre_tokenizers.ByteLevel.alphabet())
        if self.by_word:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            level, vocab = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), form["model"]["vocab"]
            self.char_of = np.arange(256, dtype="<u4")  # of a byte, for the model
            for c in range(0xA1, 0x100):
                self.char_of[list(chr(c).encode())] = [ord(x) for x in level.pre_tokenize_str(chr(c))[0][0]]
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(form["model"]["end_of_word_suffix"])]] = True
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _splits_as_known(form: dict) -> bool:
        before, model = form["pre_tokenizer"] or {}, form["model"]
        parts = before.get("pretokenizers", [])
        return (
            (form["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and [x["type"] for x in parts] == ["Split", "ByteLevel"]
            and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
            and not (parts[1]["add_prefix_space"] or parts[1]["use_regex"])
            and model["type"] == "BPE" and not model["dropout"]
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in form["added_tokens"])
        )

    @staticmethod
    def _ends_are_known(model: dict, alphabet: list[str]) -> bool:
        """Whether each word has one token with the suffix for ends, its last: the model has all bytes with and without it, and no merge spells it out."""
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return (
            bool(end) and not (model["continuing_subword_prefix"] or model["ignore_merges"])
            and all(c in vocab and c + end in vocab for c in alphabet)
            and not any((a + b).endswith(end) and not b.endswith(end) for a, b in merges)
        )

    def _tokenized(self, words: list[str]) -> list[bytes]:
        text = " ".join(words)
        if not text.isascii():
            text = self.char_of[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
        assert len(ends) == len(words)
        ids = ids.tobytes()
        return [ids[a:b] for a, b in pairwise([0, *ends])]

    def _found(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. A full generation becomes the old one, and what is used again comes back from it."""
        if len(self.kept) >= CACHE:
            self.old, self.kept = self.kept, {}
        out = list(map(self.kept.get, chunks))
        missing = [chunk for chunk, ids in zip(chunks, out, strict=True) if ids is None]
        if not missing:
            return out
        made = {chunk: ids for chunk, ids in zip(missing, map(self.old.get, missing), strict=True) if ids is not None}
        missing = [chunk for chunk in missing if chunk not in made]
        new = set(filter(str.isalpha, missing))
        split = [(chunk, WORD.findall(chunk)) for chunk in missing if chunk not in new]
        for word in set(chain.from_iterable(words for _, words in split)):
            if word not in new and word not in made:
                ids = self.kept.get(word) or self.old.get(word)
                if ids is None:
                    new.add(word)
                else:
                    made[word] = ids
        if new:
            new = list(new)
            made.update(zip(new, self._tokenized(new), strict=True))
        made.update([(chunk, b"".join([made[word] for word in words])) for chunk, words in split])
        self.kept.update(islice(((chunk, ids) for chunk, ids in made.items() if len(chunk) <= KEPT_LENGTH), CACHE))
        return [made[chunk] if ids is None else ids for chunk, ids in zip(chunks, out, strict=True)]

    def _by_chunk(self, lower: list[str]) -> list[bytes]:
        if not lower:
            return []
        split = pc.ascii_split_whitespace(apart(lower))
        coded = split.values.dictionary_encode()
        found = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, which = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[which]
        before = np.cumsum(n) - n
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - before, n) + np.arange(n.sum())]
        bounds = np.append(before, len(ids))[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in pairwise(bounds)]

    def _group(self, texts: list[str]) -> list[bytes]:
        out, plain = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            lower = text.lower()
            if not self.by_word or not PLAIN.fullmatch(text) or any(t in lower for t in self.added):
                out[i] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif len(text) > GROUP:
                out[i] = b"".join(self._by_chunk([part])[0] for part in parts(lower, GROUP))
            else:
                plain[i] = lower
        for i, ids in zip(plain, self._by_chunk(list(plain.values())), strict=True):
            out[i] = ids
        return out

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text, in their order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def ids(self, text: str) -> bytes:
        return self._group([text])[0]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a worker, for all its tasks."""
    return Encoder(path)


@lru_cache(maxsize=4)
def class_lengths(capacity: int) -> tuple[int, ...]:
    """The largest length of each class, longest first."""
    return tuple(sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True))


@lru_cache(maxsize=4)
def change(capacity: int) -> list[int]:
    """change[r]: the first piece to cut of r < capacity; it leads to the fewest pieces, and among those to the longest last one."""
    lengths = [q for q in class_lengths(capacity) if q < capacity]
    best: list[tuple[int, int]] = [(0, -capacity)]  # pieces, minus the shortest
    cut = [0]
    for r in range(1, capacity):
        options = [(best[r - q][0] + 1, max(best[r - q][1], -q), -q) for q in lengths if q <= r]
        n, least, q = min(options)
        best.append((n, least))
        cut.append(-q)
    return cut


@lru_cache(maxsize=1 << 14)
def _rest(rest: int, capacity: int) -> tuple[int, ...]:
    cut, out = change(capacity), []
    while rest:
        out.append(cut[rest])
        rest -= cut[rest]
    return tuple(sorted(out, reverse=True))


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths, longest first, that sum to n, each the largest of its class."""
    return [capacity] * (n // capacity) + list(_rest(n % capacity, capacity))


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, chunk, ranks = encoder_of(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.each(text or "" for text in batch["text"]), strict=True):
                ids += END
                start, whole, n = 0, memoryview(ids), len(ids) // 4
                for length in pieces(n, capacity):
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    rows.append((doc_id, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), n, chunk, rank))
                    start += length
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "rank"])

    return cut


def leftover_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, index, bin, offset) of counts[length] < capacity // length pieces of each length, best-fit, longest first."""
    out, bins = [], []  # bins: room, number
    n = 0
    for length in sorted(counts, reverse=True):
        for index in range(counts[length]):
            at = bisect.bisect_left(bins, (length, -1))
            room, number = bins.pop(at) if at < len(bins) else (capacity, n)
            n += number == n
            out.append((length, index, number, capacity - room))
            if room > length:
                bisect.insort(bins, (room - length, number))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class (pieces of this length in a full sequence)."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    cut = settle(map_pandas(docs, _cutter(tokenizer, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk int, rank long", "doc_id"), "pieces")
    chunks = cut.groupBy("length", "chunk").agg((F.max("rank") + 1).alias("n"))
    before = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    totals = {r["length"]: r["n"] for r in chunks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a class
    classes, plan, sequence = [], {}, 0
    for length in class_lengths(capacity):
        if length in totals:
            j = capacity // length
            classes.append((length, j, totals[length] // j * j, sequence))
            sequence += totals[length] // j
            plan[length] = totals[length] % j
    left = [(length, index, sequence + number, offset) for length, index, number, offset in leftover_plan(plan, capacity)]  # fewer than capacity // length a class
    classes_df = spark.createDataFrame(classes, "length long, j long, full long, first long")
    left_df = spark.createDataFrame(left, "length long, spare long, left_sequence long, left_offset long")
    placed = cut.join(before, ["length", "chunk"]).join(F.broadcast(classes_df), "length").withColumn("at", F.col("before") + F.col("rank"))
    placed = placed.withColumn("spare", F.when(F.col("at") >= F.col("full"), F.col("at") - F.col("full"))).join(F.broadcast(left_df), ["length", "spare"], "left")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.coalesce("left_sequence", (F.col("first") + F.floor(F.col("at") / F.col("j"))).cast("long")).alias("sequence_id"),
        F.coalesce("left_offset", F.col("at") % F.col("j") * F.col("length")).alias("offset"),
        F.col("j").alias("class"),
    )


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
