"""Spelling variants: words of a corpus that one inserted, deleted or replaced code point parts, found by a positional q-gram index.

A word padded by Q - 1 marks on either side has length + Q - 1 grams. One edit leaves max(length) - 1 of them in both words,
at places that differ by one at most. Hence (1) of grams in order of their rarity, two near words share one of the first
Q + 1 of each, at the same or the next place: these are the index's keys, with the place and the length in the key; (2) within
a key, postings of all grams of a word are merged in order of their members, and members met less often than the bound are
left; (3) what is left is verified. Words are runs of Latin-1 letters, a byte each within this module.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import _LOWER, bound_batches, materialize, mix64, passes, words

#: Grams are of three out of 26 + 64 letters and a mark, hence 91^3 at most: 12 MB that the driver and all tasks may hold.
Q = 3
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of one key that are indexed together; more are cut into parts, to each of which all of the key's probes go.
MOST_MEMBERS = 1 << 12
#: Postings that are merged at a time.
POSTINGS = 1 << 20
#: Bytes up to which check sums are worked out for many words at once.
SHORT = 48
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])


def _table() -> np.ndarray:
    """CRC-32's table of bytes (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _table()


def runs_only(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with all but ASCII letters and U+00C0 to U+00FF (a byte C3 and the one after it) made spaces."""
    solid = _LETTER[data] | (data == 0xC3)
    solid[1:] |= data[:-1] == 0xC3
    return np.where(solid, data, np.uint8(0x20))


def check_sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[begin:end], carried on from the check sum `before` (as zlib.crc32's second argument)."""
    out = np.zeros(len(begin), np.uint32)
    long = np.flatnonzero(end - begin > SHORT)
    for i in long.tolist():
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(end - begin <= SHORT)
    short = short[np.argsort(begin[short] - end[short], kind="stable")]  # longest first
    size, c = (end - begin)[short], ~before[short].astype(np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = np.searchsorted(-size, -k, side="left")
        c[:n] = _CRC[(c[:n] ^ data[begin[short[:n]] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[short] = ~c
    return out


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin:end]."""
    size = end - begin
    places = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(places[-1]) + np.repeat(begin - places[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data[at]))


def _count(noise: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                coded = _LOWER[runs_only(data)]
                met = words(coded, offsets)
                inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
                length = met.end - met.begin - (inner[met.end] - inner[met.begin])
                keep = length >= least
                text, hashed, begin, end, length = met.text[keep], met.hash[keep], met.begin[keep], met.end[keep], length[keep]
                # Words of a text once, with their number; their check sums go on from the text's id.
                _, first, n = np.unique(mix64(hashed ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                text, hashed, begin, end, length = text[first], hashed[first], begin[first], end[first], length[first]
                odd, out = np.zeros(len(n), bool), []
                if noise:
                    ids = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("doc_id").to_pylist()], np.uint32)
                    h = check_sums(coded, begin, end, ids[text])
                    odd = h % np.uint32(noise) == 0
                    for i in np.flatnonzero(odd).tolist():
                        word = coded[begin[i] : end[i]].tobytes().decode()
                        if length[i] > least:
                            at = int(h[i]) % int(length[i])
                            out.append((word[:at] + word[at + 1 :], int(n[i])))
                _, at, where = np.unique(hashed[~odd], return_index=True, return_inverse=True)
                sums = np.bincount(where, n[~odd], len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([gather(coded, begin[~odd][at], end[~odd][at]), pa.array(sums)], ["word", "n"])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out]), pa.array([k for _, k in out], pa.int64())], ["word", "n"])

    return run


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least least_length code points that occur at least least_count times in all texts.

    With `noise`, a word of a text loses one code point if `noise` divides the CRC-32 of `<doc_id>:<word>` (a null id is
    an empty string): made misspellings. A null text has no words; repeated rows count; other columns are ignored. Within
    1 MB of text, words are told apart by 64-bit hashes.
    """
    bound_batches(docs.sparkSession)
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_count(noise, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(Latin-1 bytes of all words, each between Q - 1 zeros; where each begins), with the end."""
    made = [w.encode("latin-1") for w in column.to_pylist()]
    sizes = np.fromiter(map(len, made), np.int64, len(made)) + 2 * (Q - 1)
    pad = bytes(Q - 1)
    return np.frombuffer(b"".join(pad + w + pad for w in made), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _grams(flat: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, gram as a number) of all grams."""
    number = np.diff(places) - (Q - 1)
    word = np.repeat(np.arange(len(number)), number)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    at = places[word] + place
    gram = np.zeros(len(at), np.int64)
    for k in range(Q):
        gram = gram << 8 | flat[at + k]
    return word, place, gram


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, n = np.unique(_grams(*_flat(batch.column("word")))[2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])


def _keys(ordered):
    """Rows of the index, for a word's first Q + 1 grams in order of rarity, and the probes that may meet such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_of, rank_of = ordered.value
        for batch in batches:
            flat, places = _flat(batch.column("word"))
            word, place, gram = _grams(flat, places)
            order = np.lexsort((place, rank_of[np.searchsorted(gram_of, gram)], word))
            number = np.diff(places) - (Q - 1)
            nth = np.arange(len(order)) - np.repeat(np.cumsum(number) - number, number)
            order = order[nth <= Q]
            word, place, gram, length = word[order], place[order], gram[order], (number - (Q - 1))[word[order]]
            # A probe meets words of its own length at the same place, and words one longer at the same or the next.
            for probe, further, longer in ((False, 0, 0), (True, 0, 0), (True, 0, 1), (True, 1, 1)):
                key = gram << 40 | ((place + further) & 0xFFFFF) << 20 | ((length + longer) & 0xFFFFF)
                same = np.full(len(key), probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(same), batch.column("word").take(pa.array(word)), batch.column("n").take(pa.array(word))], ["key", "probe", "word", "n"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts a and b; b is as long as a, or one longer."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def _merged(group: np.ndarray, probe: np.ndarray, flat: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, member) numbers of rows that share a group and enough grams: postings merged, and what is met too seldom left."""
    word, place, gram = _grams(flat, places)
    length = np.diff(places) - 2 * (Q - 1)
    posting = lambda w, p, g: mix64(mix64(group[w].astype(np.uint64)) ^ (g.astype(np.uint64) << np.uint64(24) | p.astype(np.uint64) & np.uint64(0xFFFFFF)))
    held = ~probe[word]
    lists, members = posting(word[held], place[held], gram[held]), word[held]
    order = np.argsort(lists, kind="stable")  # each list's members ascend
    lists, members = lists[order], members[order]
    long = np.zeros(group.max() + 1, np.int64)
    np.maximum.at(long, group[~probe], length[~probe])
    asked, put, sought = word[~held], place[~held], gram[~held]
    shorter = length[asked] < long[group[asked]]
    asked, wanted = np.concatenate([asked, asked[shorter]]), np.concatenate([posting(asked, put, sought), posting(asked[shorter], put[shorter] + 1, sought[shorter])])
    order = np.argsort(asked, kind="stable")
    asked, wanted = asked[order], wanted[order]
    low, high = np.searchsorted(lists, wanted, side="left"), np.searchsorted(lists, wanted, side="right")
    size = high - low
    # Cuts between probes, with about POSTINGS postings each.
    starts = np.flatnonzero(np.diff(asked, prepend=-1))
    before = np.concatenate([[0], np.cumsum(size)])
    cuts = [*starts[np.flatnonzero(np.diff(before[starts] // POSTINGS, prepend=-1))].tolist(), len(asked)]
    for a, b in pairwise(cuts):
        n = size[a:b]
        at = np.arange(n.sum()) + np.repeat(low[a:b] - np.cumsum(n) + n, n)
        # Runs of ascending members, a run a list: a stable sort merges them.
        merged = np.sort(np.repeat(asked[a:b], n) << 32 | members[at], kind="stable")
        first = np.flatnonzero(np.diff(merged, prepend=-1))
        times = np.diff(np.append(first, len(merged)))
        p, m = merged[first] >> 32, merged[first] & 0xFFFFFFFF
        left = times >= np.maximum(np.maximum(length[p], length[m]) - 1, 1)
        yield p[left], m[left]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and part, members before probes -> near pairs. Members of the last group go on to the next batch."""
    carried = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        (rows,) = rows
        key, part, probe = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "probe"))
        group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(part) != 0)]))
        last = np.flatnonzero((group == group[-1]) & ~probe)
        carried = rows.slice(int(last[0]), len(last)) if len(last) else rows.slice(0, 0)
        # Groups with one word, or without members or probes, have no pairs.
        use = (np.bincount(group, ~probe) > 0)[group] & (np.bincount(group, probe) > 0)[group]
        if not use.any():
            continue
        rows, group, probe = rows.filter(pa.array(use)), np.unique(group[use], return_inverse=True)[1], probe[use]
        word, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        # Words of one length meet either way; the smaller one's way is kept.
        hopeful = ((i, j) for p, m in _merged(group, probe, *_flat(rows.column("word"))) for i, j in zip(p.tolist(), m.tolist(), strict=True) if len(word[i]) < len(word[j]) or word[i] < word[j])
        pairs = [(i, j) for i, j in hopeful if one_edit(word[i], word[j])]
        if pairs:
            i, j = np.array(pairs).T
            names = rows.column("word")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(n[i]), names.take(pa.array(j)), pa.array(n[j])], ["a", "n_a", "b", "n_b"])


def near_words(counted: DataFrame, most_members: int = MOST_MEMBERS) -> DataFrame:
    """word, near, near_n: all pairs of words, either way, that exactly one inserted, deleted or replaced code point parts.

    counted: word, n, a row a word, of Latin-1 letters, without nulls. The index's hot keys are cut into parts of about
    most_members words; no pair is lost.
    """
    spark = counted.sparkSession
    grams = counted.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # a bounded list, see Q
    gram = np.sort(grams["gram"].to_numpy())
    rank = np.empty(len(grams), np.int64)
    by_gram = grams.sort_values("gram")
    rank[np.argsort(by_gram["n"].to_numpy(), kind="stable")] = np.arange(len(grams))
    keyed = materialize(counted.mapInArrow(_keys(spark.sparkContext.broadcast((gram, rank))), "key long, probe boolean, word string, n long"), "keyed")
    cuts = keyed.groupBy("key").agg(F.count_if(~F.col("probe")).alias("_m")).where(F.col("_m") > most_members).select(F.col("key").alias("_key"), F.ceil(F.col("_m") / most_members).cast("int").alias("_cuts"))
    dealt = keyed.join(cuts, F.col("key") == F.col("_key"), "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_cuts")).cast("int")
    dealt = dealt.select("key", "probe", "word", "n", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("_cuts") - 1)).otherwise(F.array(own))).alias("part"))
    found = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "probe", "word").mapInArrow(_near, "a string, n_a long, b string, n_b long")
    once = found.dropDuplicates(["a", "b"])  # a pair may share several keys
    way = lambda a, b, n: F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(n).alias("near_n"))
    return once.select(F.inline(F.array(way("a", "b", "n_b"), way("b", "a", "n_a"))))


def variants(counted: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n, a row a word of counted (word, n), which is read several times.

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if its n is at least
    ratio times the word's. The root is where forms lead from the word to: n grows with each step, so that they end.
    Roots are found by doubling, in as many rounds as the longest chain has binary digits.
    """
    near = near_words(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = counted.join(near, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    given = materialize(joined.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    leads = given.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = leads.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        leads = materialize(leads.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if leads.where("moved").isEmpty():
            break
        leads = leads.drop("moved")
    return given.join(leads.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = 0, ratio: int = 2) -> DataFrame:
    """variants() of the words that count_words() finds in docs; an empty table gives no rows."""
    return variants(materialize(count_words(docs, doc_id, text, noise), "words"), ratio)
