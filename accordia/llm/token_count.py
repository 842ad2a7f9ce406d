"""Token counts through a cache of digests: a content is encoded once for each version of a tokenizer.

The cache is a Parquet folder with a folder for each tokenizer's version in it, the SHA-256 of what decides the counts: the
tokenizer's file, the library's version, and the rule of normalisation. It holds the SHA-256 of normalised contents and their
numbers of tokens. Contents are normalised in ways that cannot change the count, so that texts that differ in white space,
and plain ones that differ in case, meet in one entry where the tokenizer leaves both out.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordia.llm.common import bound_batches, join_spread, materialize, table_path

LIMIT = 2048
#: Rule of normalisation, a part of the version.
RULE = "1"
#: Words whose numbers of tokens a worker keeps; beyond that it forgets all.
MOST_WORDS = 500_000
#: Missing digests, of 32 bytes, up to which they are sent to all tasks; beyond that, contents come to them by a shuffle.
MOST_SENT = 1 << 18
_SPACES = "\t\n\v\f\r "


class Counter:
    """Numbers of tokens as a library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library's threads would wait busily
        self.spaced = self.caseless = False
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.plain: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.plain = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        made = json.loads(tokenizer.to_str())
        steps = [made["normalizer"] or {}, made["pre_tokenizer"] or {}]
        steps = [y for x in steps for y in x.get("normalizers", x.get("pretokenizers", [x]))]
        # White space parts words and goes if normalizers are known and the split takes words out of what is between.
        kinds = {x.get("type") for x in steps}
        drops = any(x.get("type") == "Split" and x["behavior"] == "Removed" and x["invert"] for x in steps) and kinds <= {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "Split", "ByteLevel"}
        whole = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or set(x["content"]) & set(_SPACES) for x in made["added_tokens"])
        only_space = all(x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps if x.get("type") == "Replace")
        bare = all(not x.get("add_prefix_space") for x in steps)
        self.spaced = drops and whole and only_space and bare and all(self._parts(c) for c in _SPACES)
        self.caseless = self.spaced and "Lowercase" in kinds
        self.marks = [x["content"].lower().encode() for x in made["added_tokens"]]

    def _parts(self, c: str) -> bool:
        """Whether texts on either side of c count as they do alone."""
        return all(self.plain([f"{c}{x}{c}{y}"])[0] == sum(self.plain([x, y])) for x, y in (("a", "b"), ("!", "!"), ("7", "é"), ("'", "s")))

    def normalise(self, text: bytes) -> bytes:
        """A text with the same number of tokens. Case goes only from plain ASCII without an added token's string, as letters
        can make one character with a mark after them in one case alone."""
        if not self.spaced:
            return text
        text = b" ".join(text.split())
        if not self.caseless or not text.isascii():
            return text
        low = text.lower()
        return text if any(x in low for x in self.marks) else low

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.spaced:
            return self.plain([x.decode("utf-8", "replace") for x in texts])
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        split = [x.split() for x in texts]
        known = self.known
        wanted = list({w for one in split for w in one if w not in known})
        for at in range(0, len(wanted), 1 << 14):
            some = wanted[at : at + (1 << 14)]
            known.update(zip(some, self.plain([w.decode("utf-8", "replace") for w in some]), strict=True))
        return [sum(map(known.__getitem__, one)) for one in split]


@cache
def counter_of(path: str) -> Counter:
    """A worker's counter, with the words it keeps, serves all its tasks."""
    return Counter(path)


def tokenizer_version(path: str) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    said = hashlib.sha256(f"{RULE} {library} {importlib.metadata.version(library)} ".encode())
    with open(path, "rb") as file:
        said.update(file.read())
    return said.hexdigest()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary()))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(x), hashlib.sha256(counter_of(path).normalise(x)).digest()) for x in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([d for _, d in made], pa.binary())], ["doc_id", "n_bytes", "digest"])

    return run


def _contents(path: str):
    """Normalised contents with their digests, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            made = {}
            for x in map(counter_of(path).normalise, _texts(batch)):
                if (digest := hashlib.sha256(x).digest()) not in seen:
                    seen.add(digest)
                    made[digest] = x
            yield pa.RecordBatch.from_arrays([pa.array([*made], pa.binary()), pa.array([*made.values()], pa.binary())], ["digest", "text"])

    return run


def _counts(path: str):
    """Contents of a shuffle by digest -> digest, n_tokens, each digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            made = {d: x for d, x in zip(batch.column("digest").to_pylist(), _texts(batch), strict=True) if d not in seen}
            seen |= made.keys()
            yield pa.RecordBatch.from_arrays([pa.array([*made], pa.binary()), pa.array(counter_of(path).count([*made.values()]), pa.int64())], ["digest", "n_tokens"])

    return run


def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n_tokens of one version; empty if its folder is not there yet. Entries that two runs wrote count once."""
    try:
        return spark.read.schema("digest binary, n_tokens long").parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, store: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row; appends the counts that `store` lacks to it.

    tokenizer: a file of the tokenizers library (.json) or of sentencepiece (.model), at the same path on all executors.
    store: the cache's folder, which all executors share; without it, a new one. Strings of special tokens in a text become
    these tokens, as is the library's default. A null text is empty; repeated rows and null ids are rows; an empty table
    gives no rows and appends nothing; other columns are ignored. Texts are read twice, the second time only if contents
    are missing; then they are shuffled once, each content at most once a task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    store = f"{store or table_path(spark, 'token_counts')}/{tokenizer_version(tokenizer)}"
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(kept.mapInArrow(_digests(tokenizer), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, digest binary"), "digests")
    wanted = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    missing = materialize(wanted.join(cached_counts(spark, store), "digest", "left_anti").select("digest"), "missing")
    if n := missing.count():
        texts = kept.select("text").mapInArrow(_contents(tokenizer), "digest binary, text binary")
        dealt = texts.join(F.broadcast(missing), "digest", "left_semi").repartition("digest") if n <= most_sent else texts.join(missing.hint("shuffle_hash"), "digest", "left_semi")
        dealt.mapInArrow(_counts(tokenizer), "digest binary, n_tokens long").write.mode("append").parquet(store)
    found = materialize(wanted.join(cached_counts(spark, store), "digest").withColumnRenamed("digest", "its"), "counts")
    joined = join_spread(rows, "digest", found, "its", "copies", ["doc_id", "n_bytes"])
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
