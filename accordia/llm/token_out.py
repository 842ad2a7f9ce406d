"""Token-ID output: Parquet files of documents' ids, in order, with row groups, pages and indexes under control.

Files hold, a row a document, its id, its place among the file's ids, its number of ids and the ids as a list column.
Format version 2 writes integers as deltas; ids get a dictionary as long as that is smaller. Page indexes let a reader
take the pages of a range of documents, and a reader of metadata leaves the ids alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordia.llm.common import _SPACE, bound_batches, passes, table_path

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text that one output file takes, about, and the most files.
FILE_BYTES, MOST_FILES = 16 << 20, 1 << 20
#: Segments that a worker keeps; beyond that it forgets all of them. Slots of its table, and segments looked up at a time.
MOST_SEGMENTS, SLOT_BITS, BLOCK = 1_000_000, 22, 1 << 18
#: Bytes of a segment that two 64-bit numbers hold, and of longer ones that are kept at all.
SHORT, MOST_KEPT = 16, 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BYTES = np.arange(256)
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_PUNCTUATION = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])
#: Control characters that some count as white space.
_ODD_CONTROL = (_BYTES >= 0x1C) & (_BYTES <= 0x1F)
#: (lead bytes, last bytes) of white space beyond ASCII, or more than that: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
_WIDE_SPACE = ((b"\xc2", bytes([0x85, 0xA0])), (b"\xe1\x9a", b"\x80"), (b"\xe2\x80", bytes(range(0x80, 0xB0))), (b"\xe2\x81", b"\x9f"), (b"\xe3\x80", b"\x80"))


def segment_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of some UTF-8 texts begin: places at which byte-level BPE's pre-tokenizer surely parts a text.

    It never joins a character that is no white space with white space after it, nor a letter or digit with punctuation
    after it. What is before and after such a place is parted alike if it stands alone. Where a character beyond ASCII may
    be white space, or no letter, nothing is cut after it.
    """
    before = data[:-1]
    space = _SPACE[data]
    solid, word = ~(space[:-1] | _ODD_CONTROL[before]), _ALNUM[before]
    if len(data) and data.max() > 127:
        latin = np.append(False, (before[:-1] >= 0xC3) & (before[:-1] <= 0xC8) & (before[1:] > 127))[: len(before)]
        word |= latin & ~((before == 0x97) | (before == 0xB7))  # times and division signs, and with them some letters
        for lead, last in _WIDE_SPACE:
            met = np.isin(before, np.frombuffer(last, np.uint8))
            for i, b in enumerate(reversed(lead), 1):
                met[i:] &= before[:-i] == b
                met[:i] = False
            solid &= ~met
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (space[1:] & solid) | (_PUNCTUATION[data[1:]] & word)
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of whole texts, as the tokenizers library's encode gives them without special tokens around them.

    For byte-level BPE with the usual pre-tokenizer, texts are cut into segments, of which the library encodes each
    distinct one once while it is kept; segments of up to 16 bytes are told apart by these bytes as two numbers. For all
    else, and for texts that hold a string of an added token, the library encodes whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library's threads would wait busily
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        plain_bpe = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        self.by_segment = plain_bpe and made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = [x["content"].encode() for x in made["added_tokens"]]
        self.end = end_id
        self.forget()

    def forget(self) -> None:
        """Of each segment: its bytes as two numbers, its length (0 if it is in `longer`), where its ids begin, how many."""
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.low, self.high = np.zeros((2, 1 << 16), np.uint64)
        self.length, self.size, self.begin = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.known, self.longer = 0, {}
        self.ids, self.filled = np.zeros(1 << 18, np.int32), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, segments: list[bytes]) -> None:
        """Gives the next numbers to segments, with their ids."""
        found = self.plain([x.decode("utf-8", "replace") for x in segments])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids, at = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum()), slice(self.known, self.known + len(found))
        self.room(at.stop, self.filled + len(ids))
        self.begin[at], self.size[at] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.known, self.filled = at.stop, self.filled + len(ids)

    def room(self, segments: int, ids: int) -> None:
        grown = lambda x, n: x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
        self.low, self.high, self.length, self.begin, self.size = (grown(x, segments) for x in (self.low, self.high, self.length, self.begin, self.size))
        self.ids = grown(self.ids, ids)

    def short_numbers(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, bytes_of) -> np.ndarray:
        """Numbers of segments of up to SHORT bytes, by linear probing of all at once; new ones are learnt."""
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out, left, new, first = np.empty(len(low), np.int64), np.arange(len(low)), [], self.known
        while len(left):
            at = self.slots[slot]
            if (free := at < 0).any():
                mine, where = left[free], slot[free]
                self.slots[where] = mine  # of several that want a slot, the last has it
                won = self.slots[where] == mine
                mine, where = mine[won], where[won]
                numbers = np.arange(first, first + len(mine))
                first += len(mine)
                self.room(first, 0)
                self.slots[where], self.low[numbers], self.high[numbers], self.length[numbers] = numbers, low[mine], high[mine], length[mine]
                new.append(mine)
                at = self.slots[slot]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.length[at] == length[left])
            out[left[same]] = at[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << SLOT_BITS) - 1)
        if new:
            self.learn([bytes_of(i) for i in np.concatenate(new).tolist()])
        return out

    def long_numbers(self, segments: list[bytes]) -> list[int]:
        """Numbers of longer segments; those over MOST_KEPT bytes are encoded each time."""
        wanted = list(dict.fromkeys(x for x in segments if x not in self.longer))
        numbers = {x: self.known + i for i, x in enumerate(wanted)}
        self.learn(wanted)
        out = [self.longer[x] if x in self.longer else numbers[x] for x in segments]
        self.longer |= {x: i for x, i in numbers.items() if len(x) <= MOST_KEPT}
        return out

    def block(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment) of some segments; data has SHORT bytes more than they need."""
        if self.known > MOST_SEGMENTS or self.filled > 8 * MOST_SEGMENTS:
            self.forget()
        length = end - begin
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        short = length <= SHORT
        at, n = (begin, length) if (all_short := short.all()) else (begin[short], length[short])
        numbers = self.short_numbers(eights[at] & _MASKS[np.minimum(n, 8)], eights[at + 8] & _MASKS[np.maximum(n - 8, 0)], n, lambda i: data[at[i] : at[i] + n[i]].tobytes())
        if not all_short:
            every = np.empty(len(begin), np.int64)
            every[short] = numbers
            every[~short] = self.long_numbers([data[a:b].tobytes() for a, b in zip(begin[~short].tolist(), end[~short].tolist(), strict=True)])
            numbers = every
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.begin[numbers] - ends + sizes, sizes)], sizes

    def encode_segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some texts, one after another; each text's number of ids)."""
        begin = segment_begins(data, offsets)
        end = np.append(begin[1:], len(data))[: len(begin)]
        padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        found = [self.block(padded, begin[i : i + BLOCK], end[i : i + BLOCK]) for i in range(0, len(begin), BLOCK)]
        ids, sizes = (np.concatenate([np.zeros(0, kind), *(x[c] for x in found)]) for c, kind in ((0, np.int32), (1, np.int64)))
        return ids, np.diff(np.append(0, np.cumsum(sizes))[np.searchsorted(begin, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all UTF-8 texts, one after another, each with the end id; each text's number of ids)."""
        whole = np.full(len(offsets) - 1, not self.by_segment)
        if self.by_segment and any(x in data.tobytes() for x in self.added):
            whole = np.array([any(x in data[a:b].tobytes() for x in self.added) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        ids, sizes, i = [], [], 0
        for i, j in runs(whole):
            if whole[i]:
                found = self.plain([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)])
                ids.append(np.array([x for one in found for x in one], np.int32))
                sizes.append(np.array([*map(len, found)], np.int64))
            else:
                one, n = self.encode_segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(one)
                sizes.append(n)
        flat, n = np.concatenate(ids or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])
        return np.insert(flat, np.cumsum(n), self.end), n + 1


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal flags."""
    at = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
    return [(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if a < b]


@cache
def encoder_of(path: str, end_id: int) -> Encoder:
    """A worker's encoder, with what it keeps, serves all its tasks."""
    return Encoder(path, end_id)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                ids, n = encoder_of(path, end_id).encode(data, offsets)
                places = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(place + places[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                place += int(places[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Writes docs in ascending order of doc_id, null first; equal ids sort by text. A null text is empty: its end id alone.

    tokenizer: a file of the tokenizers library, at the same path on all executors. The end id follows every document.
    Without a number of files, it follows the texts' bytes alone, however docs came about. Ids are whole numbers. Strings of added tokens in a text become their ids, as the library's encode has it. Repeated
    rows are documents of their own; an empty table writes no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if files is None:  # by the texts' bytes, in a pass that shuffles a number a task
        files = max(1, -(-(kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    # Ranges of doc_id alone: their sample, which comes to the driver, holds no texts, and equal ids share a file.
    ordered = kept.repartitionByRange(min(files, MOST_FILES), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    ids = ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "parquet.compression.codec.zstd.level": 1}
    ids.write.options(**{k: str(v) for k, v in options.items()}).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, from the files.

    A file's start is the sum over the files before it: a row a file, of 16 bytes, is summed and sent to all, for at most
    MOST_FILES files.
    """
    files = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").parquet(out)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    starts = totals.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("_start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        places, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers) of read_tokens' rows; a row each."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs' ids to a new folder among the shared ones, and reads them back."""
    out = table_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, tokenizer, **options)
    return read_tokens(docs.sparkSession, out)
