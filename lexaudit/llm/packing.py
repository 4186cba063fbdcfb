"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths; equal lengths share a bucket.

A sequence is one piece, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import held

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's cache of encoded words; when full, the half of them that was used most stays.
CACHE_WORDS = 400_000
#: Bytes of text split at a time, and words given to the tokenizer at a time.
BATCH_BYTES, LEARN_WORDS = 4_000_000, 4096
#: The split of tokenizers whose words are independent of each other (a fixed value of their files).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks at the end of a word that this split cuts off, whatever lower-casing does: after a Latin letter.
TAIL = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)(\s|$)"

PIECES = "start long, length long, doc_tokens long, ids binary"


class WordEncoder:
    """Token ids of texts; the tokenizer gets each distinct word of them once.

    A tokenizer that drops white space and splits at it gives a text the ids of its words in turn, so words are looked up
    in a cache; marks at their ends are parted from them first, as the split does. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        file = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
        first = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        #: These are found in a text before it is lower-cased.
        self.added = [x["content"] for x in file.get("added_tokens", [])]
        self.splits = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True and first.get("behavior") == "Removed" and all(len(x.split()) == 1 for x in self.added)
        self.index: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths, self.uses = np.array([end_id], np.uint32), np.array([0]), np.array([1]), np.array([0])  # entry 0: the end

    def keep(self, entries: np.ndarray) -> None:
        """Leaves some entries of the cache, in their order."""
        words = [b"", *self.index]
        self.ids, ends = self.gather(np.concatenate([[0], entries]))
        self.index = dict(zip((words[k] for k in entries.tolist()), range(1, len(entries) + 1)))
        self.starts, self.lengths = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        self.uses = np.zeros(len(ends), np.int64)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some entries in turn, and where those of each end."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - ends + lengths, lengths)], ends

    def learn(self, words: list[bytes]) -> None:
        """Adds new words to the cache."""
        sizes: list[int] = []
        ids = array("I")
        for k in range(0, len(words), LEARN_WORDS):
            for x in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in words[k : k + LEARN_WORDS]], add_special_tokens=False):
                own = x.ids
                sizes.append(len(own))
                ids.extend(own)
        at = len(self.starts)
        self.index.update(zip(words, range(at, at + len(words))))
        lengths = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of some texts in turn, and how many each text has."""
        if not self.splits:
            return texts, np.ones(len(texts), np.int64)
        plain = pc.ascii_lower(texts)
        if any(pc.any(pc.match_substring(plain, x)).as_py() for x in self.added):
            plain = texts
        else:
            plain = pc.replace_substring_regex(plain, TAIL, r"\1 \2\3")
        parts = pc.ascii_split_whitespace(plain)
        return parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls) in turn, the end id after each; tokens of each text, with that id."""
        if len(self.index) > CACHE_WORDS:
            self.keep(np.sort(np.argsort(-self.uses[1:], kind="stable")[: CACHE_WORDS // 2] + 1))
        words, sizes = self.words(texts)
        coded = words.dictionary_encode()
        kinds = coded.dictionary.cast(pa.binary()).to_pylist()
        entry = np.fromiter(map(self.index.get, kinds, repeat(-1)), np.int64, len(kinds))
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            entry[fresh] = np.arange(len(fresh)) + len(self.starts)
            self.learn([kinds[k] for k in fresh.tolist()])
        last = np.cumsum(sizes + 1) - 1
        at = np.zeros(len(words) + len(texts), np.int64)
        inside = np.ones(len(at), bool)
        inside[last] = False
        at[inside] = entry[coded.indices.to_numpy(zero_copy_only=False)]
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, ends = self.gather(at)
        return ids, np.diff(ends[last], prepend=0)


def decompose(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: the longest power of two as often as it fits, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of runs of texts of about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(ends):
        end = min(int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0))) + 1, len(ends))
        yield begin, end
        begin = end


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document's tokens (``end_id`` after the last) are cut into pieces of ``max_length``, a power of two, and of the binary
    digits of what is left. ``length`` is the bucket; a piece is a whole sequence of its bucket: ``offset`` is 0 and
    ``sequence_id`` unique. Documents are mapped one by one, without a shuffle, and the pieces of a bucket follow each
    other in each partition; ``write_buckets`` writes a folder for each.

    Null or empty text: the end id alone, one piece of length 1. Null and repeated ids are kept as they are, row by row.
    Other columns are not read. A text of any length is one array of ids in its task.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held((tokenizer_path, end_id), lambda: WordEncoder(tokenizer_path, end_id))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for begin, end in slices(texts, BATCH_BYTES):
                ids, counts = encoder.encode(texts.slice(begin, end - begin))
                pieces = [decompose(n, max_length) for n in counts.tolist()]
                per_doc = np.fromiter(map(len, pieces), np.int64, len(pieces))
                lengths = np.fromiter((x for p in pieces for x in p), np.int64, int(per_doc.sum()))
                ends = np.cumsum(lengths)
                doc = np.repeat(np.arange(len(pieces)), per_doc)
                begins = ends - lengths
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin).take(pa.array(doc)), pa.array(begins - (np.cumsum(counts) - counts)[doc]), pa.array(lengths), pa.array(counts[doc]), data],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(cut_up, f"doc_id {kind}, {PIECES}").sortWithinPartitions("length")
    return out.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes one folder for each piece length, for trainers that draw batches of equal lengths.

    Each task writes a file to each bucket it has pieces of, without a shuffle: at most the logarithm of the longest length
    and one. An empty table gives an empty folder; columns named ``length`` are not repeated inside the files.
    """
    pieces.write.partitionBy("length").parquet(path)
