"""Token counts through a cache of digests that outlives the run.

A text's content is normalised (by default only null to empty, since a byte vocabulary tells every
byte; a caller may pass what the tokenizer itself is blind to) and named by its SHA-256. The cache is a
Parquet folder with one part per tokenizer version, itself a digest of the tokenizer's file, its library
and the way it is called, so that another version never meets the wrong counts. Digests of the table
are joined to the stored counts; one text of each digest that is missing is encoded, and its count
appended. All counts are then read from the cache.

Only digests are shuffled for hits. Texts of misses are shuffled once, after the copies within a task
are merged, so a text that a third of all rows hold stays one row a task. If at most FEW_MISSES
digests are missing they are broadcast (that is the size check) and other texts never leave their task.
An append that is cut off leaves true counts only, and what two runs append twice is read once.

Long texts are encoded in pieces of about PIECE characters where the tokenizer's own rule splits anyway:
before a single space between a letter or digit and another. Texts or tokenizers without such
places are encoded whole.

Within such a text, a word is what white space begins: the rule always splits between a character that is none and
a space, tab or line break, so a text's count is the sum of its words' counts. A worker keeps the counts of the
first WORDS short words that the library gave it; digests deal texts at random, so frequent words are soon among them. What a
full worker doesn't know is encoded as one string a piece, so text of ever new words costs little more than whole texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; null and repeated keys are rows of
their own; special tokens in a text count as the library takes them by default; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.state import kept
from parapet.staging import stage

LIMIT = 512
#: Misses that are broadcast at most (32 bytes each), and characters that are encoded at once (or one piece).
FEW_MISSES, PIECE = 200_000, 1 << 18
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Words whose counts a worker keeps at most, and their most characters.
WORDS, WORD = 1 << 17, 48
# White space of other kinds begins no word: Python counts four controls to it that the tokenizer's rule doesn't.
# Nothing is tried twice (++), else a long text between such characters would hold a state for each.
_WORDS = re.compile(r"\s*+\S++(?:[^\S \t\n\r]\s*+\S*+)*+|\s+")
_ROWS = 4096


def empty_for_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def version_of(path: str) -> str:
    """The digest of a tokenizer's version: its file, its library's version, and the call."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    call = f"{library.__name__} {library.__version__}; no special tokens added, no truncation, no padding; "
    return hashlib.sha256(call.encode() + Path(path).read_bytes()).hexdigest()


class TokenCounter:
    """Token counts by the library that reads ``path``: sentencepiece for ``.model`` files, else tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.version = version_of(path)
        self.words: dict[str, int] = {}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            self.splits = False
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # The byte-level rule starts a new word at such a space; no special token may reach over it.
        read = json.loads(Path(path).read_text(encoding="utf-8"))
        rule, added = read.get("pre_tokenizer") or {}, read.get("added_tokens") or []
        plain = all(not re.search(r"\s", t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
        self.splits = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not read.get("normalizer") and plain

    def pieces(self, text: str, size: int = PIECE) -> Iterator[str]:
        """The text cut where the tokenizer splits anyway, into pieces of ``size`` characters or a little more."""
        start = 0
        while self.splits and len(text) - start > size:
            found = _CUT.search(text, start + size)
            if found is None:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def known(self, piece: str) -> tuple[int, list[str]]:
        """The tokens of a piece's words that are kept, and what is left to encode; its parts may be counted singly."""
        if not self.splits:
            return 0, [piece]
        words = _WORDS.findall(piece)
        found = list(map(self.words.get, words))
        rest = [w for w, n in zip(words, found) if n is None]
        if rest and len(self.words) >= WORDS:
            rest = ["".join(rest)]
        return sum(filter(None, found)), rest

    def counts(self, texts: list[str], size: int = PIECE) -> list[int]:
        out, part, owners, room = [0] * len(texts), [], [], size
        for i, text in enumerate(texts):
            for piece in self.pieces(text, size):
                n, rest = self.known(piece)
                out[i] += n
                part += rest
                owners += [i] * len(rest)
                room -= len(piece)
                if room <= 0:
                    self._add(part, owners, out)
                    part, owners, room = [], [], size
        self._add(part, owners, out)
        return out

    def _add(self, part: list[str], owners: list[int], out: list[int]) -> None:
        different = list(dict.fromkeys(part))
        found: dict[str, int] = {}
        for start in range(0, len(different), _ROWS):
            some = different[start:start + _ROWS]
            found.update(zip(some, self.encode(some)))
        for i, text in zip(owners, part):
            out[i] += found[text]
        if self.splits and len(self.words) < WORDS:
            short = ((text, n) for text, n in found.items() if len(text) <= WORD)
            self.words.update(islice(short, WORDS - len(self.words)))


def _counted(path: str, version: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("token counter", path, version), lambda: TokenCounter(path))
        if counter.version != version:
            raise ValueError(f"{path} differs between the driver and this executor")
        for batch in batches:
            # A batch may hold many long texts; they become Python strings a few at a time.
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counter.counts(part.column("content").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of a version, or None where nothing is stored yet."""
    folder = f"{cache}/version={version}"
    if not _exists(spark, folder):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    df: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, normalise: Callable[[Column], Column] = empty_for_null,
) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row; counts that ``cache`` lacks are added to it.

    ``n_bytes`` is the size of the text as it stands. The tokenizer is read from ``path`` on the driver and the executors.
    """
    spark, version = df.sparkSession, version_of(path)
    content = normalise(F.col(text))
    digest = F.unhex(F.sha2(content, 256))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = stage(df.select(F.col(key).alias("key"), size.alias("n_bytes"), digest.alias("digest")), "digests")
    known = stored(spark, cache, version)
    misses, few = None, False
    if known is not None:
        misses = stage(rows.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
        n_misses = misses.count()
        few = n_misses <= FEW_MISSES
    if misses is None or n_misses:
        texts = df.select(digest.alias("digest"), content.alias("content"))
        if few:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        texts = texts.dropDuplicates(["digest"])
        if misses is not None and not few:
            texts = texts.join(misses, "digest", "left_semi")
        counted = texts.mapInArrow(_counted(path, version), "digest binary, n_tokens long")
        counted.write.mode("append").parquet(f"{cache}/version={version}")
    # Written, so that the join may split a digest that very many rows have.
    found = rows.join(stage(stored(spark, cache, version), "counts"), "digest", "left")
    n = F.when(F.col("n_tokens").isNull(), F.raise_error(F.lit("a count is gone from the cache"))).otherwise(F.col("n_tokens"))
    out = found.select(F.col("key").alias(key), "n_bytes", n.cast("long").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
