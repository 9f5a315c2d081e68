"""Token-ID output: a Parquet file format of token ids per document, in document order.

Layout of the written folder: one Parquet file per range of doc_id, files and rows in ascending order. Columns: doc_id, file_no,
start_in_file, n_tokens (all DELTA_BINARY_PACKED) and ids (list<int32>, dictionary-encoded while the dictionary fits a page, else
delta-encoded). Row groups and pages are bounded, and the page indexes that the writer adds let a reader fetch the metadata columns, or the ids of a
doc_id range, without reading the rest.

Defined results: a null or empty text is one end id; rows with equal doc_id lie side by side, ordered by a hash of their text; an empty
table gives an empty folder and no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 256 << 10
#: Distinct words whose ids a Python worker remembers, at some 40 bytes each; beyond that it forgets them all and starts again.
REMEMBERED_WORDS = 1_000_000
#: Bytes of a word up to which it is remembered.
LONGEST = 64
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, LONGEST + 1), dtype=np.uint64) | np.uint64(1)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes with the tokenizers library, each distinct white-space-delimited word once.

    Sound only for tokenizers that never join characters across ASCII white space and drop it, which `word_wise` verifies from the
    tokenizer's own definition; others encode whole texts. Two more steps save repeated work and are as exact: words of ASCII letters are looked up in lower case
    (the tokenizer lowers them itself), and a run of plain punctuation after a letter or digit is a word of its own (the tokenizer splits there).
    """

    #: Closing punctuation that is split off; without < > = ' and anything that composes with a mark or belongs to a special token's ends.
    PEEL = r"^(?P<core>.*[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?P<tail>[.,;:!?#*$%&|]+)$"

    LETTERS = re.compile(r"[a-zà-öø-ÿ]+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.word_wise = self._drops_space(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.forget()

    @staticmethod
    def _drops_space(path: str) -> bool:
        spec = json.load(open(path, encoding="utf-8"))
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = (spec.get("normalizer") or {}).get("normalizers", [])
        drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
        plain = [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1].get("content") == " "
        bpe = spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>"
        return bool(drops and plain and bpe and all(t["content"].startswith("<") and " " not in t["content"] for t in spec["added_tokens"]))

    def forget(self) -> None:
        """The remembered words: sorted 64-bit keys, a 32-bit check each, and where their ids lie in the pool."""
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 18, np.int32), 0

    @staticmethod
    def _keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, check and length of each word, from its bytes and random multipliers by position (universal hashing)."""
        _, offsets, data = words.buffers()
        off = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
        size = np.diff(off)
        at = np.minimum(np.arange(len(raw)) - np.repeat(off[:-1] - off[0], size), LONGEST)
        c = raw.astype(np.uint64) + np.uint64(1)
        ends = off - off[0]
        sums = [np.diff(np.r_[np.uint64(0), np.cumsum(c * r[at])][ends]) for r in _MULTIPLIERS]
        return C.mix(sums[0] + size.astype(np.uint64)), (C.mix(sums[1]) >> np.uint64(32)).astype(np.uint32), size

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. `words` starts with those of letters alone.

        Those are encoded in runs with spaces between them: each is one pre-token, so its last token, and no other, carries the end-of-word suffix.
        """
        n = next((i for i, w in enumerate(words) if not self.LETTERS(w)), len(words))
        flat, size = [], []
        for i in range(0, n, 1000):
            ids = np.array(self.tok.encode(" ".join(words[i : min(n, i + 1000)]), add_special_tokens=False).ids, np.int32)
            flat.append(ids)
            size.append(np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])]))
            if len(size[-1]) != min(n, i + 1000) - i or size[-1].sum() != len(ids):
                raise ValueError("this tokenizer does not end each word by one token of its own")
        rest = [e.ids for e in self.tok.encode_batch_fast(words[n:], add_special_tokens=False)]
        flat += [np.array(x, np.int32) for x in rest]
        size.append(np.array([len(x) for x in rest], np.int64))
        return np.concatenate([np.empty(0, np.int32), *flat]), np.concatenate(size)

    def _spans(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct words lie in the pool; words not remembered are encoded first."""
        key, check, size = self._keys(words)
        at = np.searchsorted(self.key, key)
        safe = np.minimum(at, max(0, len(self.key) - 1))
        known = (self.key[safe] == key) & (self.check[safe] == check) if len(self.key) else np.zeros(len(key), bool)
        begin, end = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        begin[known] = self.begin[safe[known]]
        end[known] = begin[known] + self.size[safe[known]]
        if len(new := np.flatnonzero(~known)):
            spelled = words.take(pa.array(new)).to_pylist()
            letters = np.array([self.LETTERS(w) is None for w in spelled])
            order = np.argsort(letters, kind="stable")
            new = new[order]
            flat, n = self._ids([spelled[i] for i in order])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.r_[self.pool, np.empty_like(self.pool)]
            self.pool[self.used : self.used + len(flat)] = flat
            stop = self.used + np.cumsum(n)
            begin[new], end[new] = stop - n, stop
            self.used += len(flat)
            keep = new[size[new] < LONGEST]  # longer words are not told apart by their keys
            keep = keep[np.argsort(key[keep])]
            put = np.searchsorted(self.key, key[keep])
            insert = lambda old, v: np.insert(old, put, v.astype(old.dtype))
            self.key, self.check, self.begin, self.size = insert(self.key, key[keep]), insert(self.check, check[keep]), insert(self.begin, begin[keep]), insert(self.size, end[keep] - begin[keep])
        return begin, end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if not self.word_wise:
            ids = [e.ids for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), np.int32), np.array([len(x) for x in ids], np.int64)
        off, code, names = C.split_words(texts)
        plain = pc.and_(pc.string_is_ascii(names), pc.invert(pc.match_substring(names, "<")))
        names = pc.if_else(plain, pc.ascii_lower(names), names)
        parts = pc.extract_regex(names, self.PEEL)
        core, tail = pc.struct_field(parts, "core"), pc.struct_field(parts, "tail")
        core, tail = pc.coalesce(core, names).dictionary_encode(), pc.fill_null(tail, "").dictionary_encode()
        if len(self.key) > REMEMBERED_WORDS:
            self.forget()
        spans = [self._spans(part.dictionary) for part in (core, tail)]
        code_of = [part.indices.to_numpy() for part in (core, tail)]
        begin, end = (np.column_stack([s[k][i] for s, i in zip(spans, code_of)]).ravel() for k in (0, 1))
        # the ids of the batch's distinct words, then of its texts
        flat, size = self._gather(self.pool, begin, end)
        ends = np.cumsum(size)[1::2]
        flat, size = self._gather(flat, np.r_[0, ends[:-1]][code] if len(ends) else code, ends[code] if len(ends) else code)
        return flat, np.diff(np.r_[0, np.cumsum(size)][off])

    @staticmethod
    def _gather(pool: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        shift = begin - np.r_[0, np.cumsum(size)[:-1]] if len(size) else begin
        at = np.repeat(shift.astype(np.int32) if len(pool) < 1 << 31 else shift, size)
        at += np.arange(len(at), dtype=at.dtype)
        return pool[at], size


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, at: str, path: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) into the file format in folder `at`. The one shuffle is a range sort of the texts by doc_id."""
    C.ship(docs.sparkSession)

    def encode(it):
        enc, pid, before = encoder(path), TaskContext.get().partitionId(), 0
        for b in C.larger(it):
            ids, size = enc.encode(b.column(1))
            ends = np.cumsum(size)
            ids = np.insert(ids, ends, end_id)
            size = size + 1
            off = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(before + off[:-1]), pa.array(size), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                names=["doc_id", "file_no", "start_in_file", "n_tokens", "ids"],
            )
            before += int(off[-1])

    # equal rows may lie in any order, so a number splits them, however many there are, over the ranges
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(C.partitions(docs.sparkSession), "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n")
    (
        rows.select("doc_id", "text").mapInArrow(C.lean(encode), "doc_id long, file_no int, start_in_file long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES)).option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#start_in_file", "false")
        .option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES)).option("parquet.page.row.count.limit", "1000")
        .parquet(at)
    )


FILE = "doc_id long, file_no int, start_in_file long, n_tokens long, ids array<int>"


def _starts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Add start to rows that have file_no and start_in_file, from the files' metadata columns alone."""
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("t"))  # a row per file
    offsets = totals.select("file_no", F.coalesce(F.sum("t").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return rows.join(offsets, "file_no").withColumn("start", F.col("o") + F.col("start_in_file")).drop("o", "file_no", "start_in_file")


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, n_tokens, ids and start of every document of a written folder."""
    files = spark.read.schema(FILE).parquet(at)
    return _starts(files, files)


def digest(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of a written folder."""

    def crc(it):
        for b in it:
            lists = b.column(4)
            flat, off = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "file_no", "start_in_file", "n_tokens", "ids_crc32"])

    C.ship(spark)
    files = spark.read.schema(FILE).parquet(at)
    sums = files.mapInArrow(C.lean(crc), "doc_id long, file_no int, start_in_file long, n_tokens long, ids_crc32 long")
    return _starts(files, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    at = C.scratch(spark, "tokens")
    write_tokens(docs, at, path or tokenizer_path())
    return digest(spark, at)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(C.table(spark, sf_dir, "documents"))
