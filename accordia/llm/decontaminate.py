"""Benchmark decontamination by a BM25 index of the test items with block-max pruning.

Every passage of every training text is a query: windows of twice the items' length, half overlapping, so that each item
fits into one whole. An item's threshold is the least score that a passage with the wanted share of its question's and
its answer's shingles can have (see most_lost), so that retrieval loses nothing that would be verified. A posting's weight
is its BM25 impact over that threshold, so that 1 serves all items. Passages are scored in numpy, many at a time: a bound
from the words' largest weights, then, for what is left, bounds from the largest weights in each block of items; postings
are read of those blocks alone that can reach the threshold. Every item at or above it is retrieved and verified.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import PUNCTUATION, bound_batches, passes, spans, without, words
from accordia.llm.near_dup import shingles, shingles_in_order

OVERLAP, SHINGLE = 0.8, 5
K1, B = 1.2, 0.75
#: Items are indexed in shards of so many bytes, each of which is sent to the executors for a pass over the texts.
SHARD_BYTES = 16 << 20
MOST_BLOCKS, LEAST_BLOCK = 64, 4
#: Bounds of passages by blocks, and postings, that are held at a time.
HELD = 1 << 22
#: Scores are sums of rounded numbers: so much less than a threshold still reaches it.
ROUNDING = 1e-9
#: Items whose thresholds are found at a time.
AT_ONCE = 1 << 11
ANSWER_ENDS = b".!?\n"


class Item(NamedTuple):
    id: int
    words: np.ndarray
    question: tuple[int, np.ndarray]  # words a shingle (fewer if it has fewer), shingles
    answer: tuple[int, np.ndarray]
    parts: list[np.ndarray]  # words of question and answer, or of the whole item if they are not apart


class Index(NamedTuple):
    """Items of one class of lengths: stride in words, thresholds, vocabulary (sorted hashes), postings by word, in blocks."""

    stride: int
    items: list[Item]
    threshold: np.ndarray  # by item: share of its score for itself
    vocabulary: np.ndarray
    top: np.ndarray  # by word: the largest weight
    item: np.ndarray  # by posting, in order of word and item
    weight: np.ndarray
    size: int  # items a block
    block_at: np.ndarray  # by word: its first entry among the blocks' entries
    block: np.ndarray  # by entry: the block, the largest weight of the word in it, its first posting
    block_top: np.ndarray
    posting_at: np.ndarray


def split_item(text: bytes) -> tuple[bytes, bytes]:
    """(question, answer): the answer is the last sentence or line, the question what comes before; one sentence is both."""
    body = text.rstrip(ANSWER_ENDS + b" \t\r")
    cut = max(body.rfind(bytes([c])) for c in ANSWER_ENDS) + 1
    return (text[:cut], text[cut:]) if cut else (text, text)


def _hashes(text: bytes) -> np.ndarray:
    return words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PUNCTUATION).hash


def most_lost(parts: list[np.ndarray], weights: list[np.ndarray], shingle: int, overlap: float) -> np.ndarray:
    """Of each sequence of words, the most weight of words outside a text that holds `overlap` of its distinct shingles.

    A word is outside only if all shingles over it are; so many of them may miss that the share is reached. The best choice
    of missing shingles is found along the sequence by how many miss so far and how long the present run of missing ones
    is. A shingle's later occurrences miss for free, which errs to the safe side. Sequences are worked on side by side.
    """
    out = np.zeros(len(parts))
    grams = [shingles_in_order(h, shingle) for h in parts]
    distinct = np.array([len(np.unique(g)) for g in grams], np.int64)
    spare = distinct - np.ceil(overlap * distinct - ROUNDING).astype(np.int64)
    open_ = [i for i in np.argsort([len(g) for g in grams], kind="stable").tolist() if spare[i] > 0]
    for s in range(0, len(open_), AT_ONCE):
        some = open_[s : s + AT_ONCE]
        steps, most = max(len(grams[i]) for i in some), int(max(spare[i] for i in some))
        gain, cost = np.zeros((len(some), steps, shingle + 1)), np.ones((len(some), steps), bool)
        last = np.array([len(grams[i]) - 1 for i in some])
        for row, i in enumerate(some):
            place = np.arange(len(parts[i]))
            ends = np.minimum(place, last[row])  # the last shingle over a word, and how many are over it
            np.add.at(gain[row], (ends, ends - np.maximum(0, place - shingle + 1) + 1), weights[i])
            cost[row, np.setdiff1d(np.arange(last[row] + 1), np.unique(grams[i], return_index=True)[1])] = False
        gain = np.cumsum(gain, axis=2)  # by the length of the run that ends at a shingle
        best = np.full((len(some), shingle + 1, most + 1), -np.inf)  # by run so far, by number missing
        best[:, 0, 0] = 0
        allowed = np.arange(most + 1) <= spare[some][:, None]
        for step in range(steps):
            run = np.minimum(np.arange(shingle + 1) + 1, shingle)
            taken = best + gain[:, step, run][:, :, None]
            paid = np.full_like(taken, -np.inf)
            paid[:, :, 1:] = taken[:, :, :-1]
            taken = np.where(cost[:, step, None, None], paid, taken)
            new = np.full_like(best, -np.inf)
            new[:, 0] = best.max(axis=1)
            new[:, 1:] = taken[:, :-1]
            new[:, shingle] = np.maximum(new[:, shingle], taken[:, shingle])
            best = np.where(allowed[:, None, :], new, -np.inf)
            done = last == step
            out[np.array(some)[done]] = best[done].max(axis=(1, 2))
    return out


def make_indexes(items: list[tuple[int, bytes]], shingle: int = SHINGLE, overlap: float = OVERLAP, retrieve: float | None = None) -> list[Index]:
    """An index for each power of two that items' numbers of words reach; items without words are in none."""
    classes: dict[int, list[Item]] = {}
    for id_, text in items:
        h = _hashes(text)
        if len(h):
            question, answer = map(_hashes, split_item(text))
            apart = len(question) and len(answer) and len(question) + len(answer) == len(h)
            parts = [question, answer] if apart else [h]
            question, answer = (x if len(x) else h for x in (question, answer))
            both = [(min(shingle, len(x)), shingles(x, shingle)) for x in (question, answer)]
            classes.setdefault(max(16, 1 << (len(h) - 1).bit_length()), []).append(Item(id_, h, *both, parts))
    return [_index(stride, sorted(found, key=lambda x: x.id), shingle, overlap, retrieve) for stride, found in sorted(classes.items())]


def _index(stride: int, items: list[Item], shingle: int, overlap: float, retrieve: float | None) -> Index:
    mean = sum(len(x.words) for x in items) / len(items)
    counts = [Counter(x.words.tolist()) for x in items]
    df = Counter(t for c in counts for t in c)
    postings, shares = [], []
    for i, (x, c) in enumerate(zip(items, counts, strict=True)):
        impact = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x.words) / mean)) for t, n in c.items()}
        total = sum(impact.values())
        postings += [(t, i, v / total) for t, v in impact.items()]
        # A word's weight is dealt out over its places, as it is lost only if all of them are.
        shares.append([np.array([impact[t] / total / c[t] for t in p.tolist()]) for p in x.parts])
    lost = most_lost([p for x in items for p in x.parts], [w for one in shares for w in one], shingle, overlap)
    lost = np.add.reduceat(lost, np.cumsum([0] + [len(x.parts) for x in items])[:-1])
    threshold = np.maximum(1 - lost, 1e-6) if retrieve is None else np.full(len(items), retrieve)
    word = np.array([p[0] for p in postings], np.uint64)
    item, weight = np.array([p[1] for p in postings], np.int64), np.array([p[2] for p in postings])
    weight = weight / threshold[item]
    order = np.lexsort((item, word))
    word, item, weight = word[order], item[order], weight[order]
    vocabulary, at = np.unique(word, return_index=True)
    size = max(LEAST_BLOCK, -(-len(items) // MOST_BLOCKS))
    key = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(at, len(word)))) * (len(items) + 1) + item // size
    blocks, first = np.unique(key, return_index=True)
    entries = np.searchsorted(blocks, np.arange(len(vocabulary) + 1) * (len(items) + 1))
    return Index(stride, items, threshold, vocabulary, np.maximum.reduceat(weight, at), item, weight, size, entries, blocks % (len(items) + 1), np.maximum.reduceat(weight, first), np.append(first, len(word)))


def _expand(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists at[r] .. at[r + 1]: (which of rows, place in the lists) of every entry."""
    n = at[rows + 1] - at[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)


def search(index: Index, text: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(text, first word, end word, item's place in the index, score) of each passage and item at or above its threshold."""
    if not len(hashes):
        return []
    least = 1 - ROUNDING
    word = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[word] == hashes)
    # Cells of `stride` words; a passage is a cell and the next one of the same text.
    begins = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    place = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))
    new = (place % index.stride == 0).cumsum() - 1
    cell, cells = new[known], new[-1] + 1
    once = np.unique(cell * len(index.vocabulary) + word[known])  # a word counts once a cell
    cell, word = once // len(index.vocabulary), once % len(index.vocabulary)
    cell_at = np.flatnonzero(place % index.stride == 0)
    follows = np.append(text[cell_at[1:]] == text[cell_at[:-1]], False)

    bound = np.bincount(cell, index.top[word], cells)
    hopeful = bound + np.where(follows, np.append(bound[1:], 0), 0) >= least
    needed = hopeful | np.append(False, hopeful[:-1] & follows[:-1])
    stay = needed[cell]
    cell, word = cell[stay], word[stay]
    n_blocks = -(-len(index.items) // index.size)
    step, out = max(1, HELD // n_blocks), []
    for c in range(0, cells, step):
        a, b = np.searchsorted(cell, [c, c + step + 1])
        which, at = _expand(index.block_at, word[a:b])
        held, own = min(step + 1, cells - c), min(step, cells - c)
        x, block = cell[a:b][which] - c, index.block[at]
        tops = np.bincount(x * n_blocks + block, index.block_top[at], held * n_blocks).reshape(held, n_blocks)
        tops[:-1] += np.where(follows[c : c + held - 1, None], tops[1:], 0)
        live = tops >= least
        live[own:] = False
        # Entries of live blocks, by the passage that their cell begins and by the one that it ends.
        here = live[x, block]
        before = (x > 0) & np.append(False, follows[c : c + held - 1])[x] & live[x - 1, block]
        once = np.unique(np.concatenate([x[here], x[before] - 1]) * len(index.block) + np.concatenate([at[here], at[before]]))
        out += _scores(index, once // len(index.block), once % len(index.block), c, cell_at, follows, text, least)
    return out


def _scores(index: Index, passage: np.ndarray, entry: np.ndarray, c: int, cell_at: np.ndarray, follows: np.ndarray, text: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
    """Exact scores from the postings of (passage, entry), passages in order and counted from c, some at a time."""
    n = np.cumsum(index.posting_at[entry + 1] - index.posting_at[entry])
    out, at = [], 0
    while at < len(entry):
        end = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + HELD, side="right")))
        if end < len(entry):  # whole passages, one at least
            end = int(np.searchsorted(passage, passage[end])) if passage[end] > passage[at] else int(np.searchsorted(passage, passage[at], side="right"))
        which, posting = _expand(index.posting_at, entry[at:end])
        keys, back = np.unique(passage[at:end][which] * len(index.items) + index.item[posting], return_inverse=True)
        score = np.bincount(back, index.weight[posting])
        for k, v in zip(keys[score >= least].tolist(), score[score >= least].tolist(), strict=True):
            first, i = divmod(k, len(index.items))
            first += c
            last = first + 1 + int(follows[first])
            out.append((int(text[cell_at[first]]), int(cell_at[first]), int(cell_at[last]) if last < len(cell_at) else len(text), i, v * float(index.threshold[i])))
        at = end
    return out


def _scan(indexes: list[Index], overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                found = words(data, offsets, PUNCTUATION)
                at = spans(found.text, part.num_rows)
                best: dict[tuple[int, int], tuple] = {}
                for index in indexes:
                    held: dict[tuple[int, int, int], np.ndarray] = {}
                    for text, start, end, i, score in search(index, found.text, found.hash):
                        x = index.items[i]
                        for n in {x.question[0], x.answer[0]}:
                            if (start, end, n) not in held:
                                held[start, end, n] = shingles(found.hash[start:end], n)
                        q, a = (float(np.isin(wanted, held[start, end, n], assume_unique=True).mean()) for n, wanted in (x.question, x.answer))
                        if q >= overlap and a >= overlap and ((text, x.id) not in best or best[text, x.id][0] < score):
                            best[text, x.id] = (score, q, a, int(start - at[text]), int(end - at[text]))
                ids = part.column("id").to_pylist()
                columns = [[ids[t] for t, _ in best], [i for _, i in best], *([v[c] for v in best.values()] for c in range(5))]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "end_word"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", retrieve: float | None = None, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word, end_word: a row for each text and item it leaks.

    Words are lower-cased and parted by all ASCII but letters and digits. A passage leaks an item if at least `overlap` of
    the five-word shingles of its question, and of its answer, are in the passage; the row tells the passage with the
    best score, as word numbers. Passages are windows of twice a power of two, 16 or more, that is at least the item's
    number of words, one from each multiple of it: question and answer that lie within that number of words together are
    always in one, those over twice as far apart never. Retrieval loses no such passage, unless `retrieve` sets a share
    of an item's score for itself that a passage must reach as well. Null and empty texts and items match nothing; of rows that share a doc_id each is
    searched; repeated items count as items; other columns are ignored; empty tables give an empty result. Ids are whole
    numbers. Items are sent to the executors in shards of at most `shard_bytes` of text and one item more, each of which
    has its own index and takes a pass over the texts.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    kind = "id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, end_word long"
    out = None
    for shard in range(shards):
        mine = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard) if shards > 1 else wanted
        indexes = make_indexes([(r["item"], bytes(r["text"])) for r in mine.toLocalIterator()], overlap=overlap, retrieve=retrieve)
        found = plain.mapInArrow(_scan(indexes, overlap), kind)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", doc_id)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose doc_id leaks no item, in the columns of docs; rows with a null doc_id stay."""
    return without(docs, doc_id, find_leaks(docs, items, doc_id, text, **options).select(doc_id))
