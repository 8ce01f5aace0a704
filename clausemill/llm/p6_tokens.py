"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's own pattern. The distinct new words of
a batch lie as one flat array of symbols; each round finds every adjacent pair's rank
by binary search over the sorted pair keys, takes the lowest of each word and merges
all its places at once, until no pair of any word is in the table.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clausemill.session import read

#: The pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, for the faster standard engine (whose \s holds more).
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int64(2**31 - 1)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """The sorted keys of all pairs of symbols that join to a symbol, with its id.

    Fixed by the vocabulary (some hundred thousand pairs), whatever the corpus.
    """
    keys, ids = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                keys.append((a << 32) | b)
                ids.append(rank)
    order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
    return {
        "keys": np.array(keys, dtype=np.uint64)[order],
        "ids": np.array(ids, dtype=np.int64)[order],
        "bytes": np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64),
    }


def merge_rounds(words: list[bytes], table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words after merging, flat, and each word's count of them."""
    keys, ids = table["keys"], table["ids"]
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    sym = table["bytes"][flat]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), size)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ids[at], NONE)

    while len(sym):
        rank = np.full(len(sym), NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = ranks_of(sym[inside], sym[inside + 1])
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        count = np.diff(np.r_[first, len(sym)])
        alive = np.repeat(lowest != NONE, count)
        if not alive.all():  # words that are ready leave the array
            done.append((word[~alive], sym[~alive]))
            sym, word, rank, lowest, count = sym[alive], word[alive], rank[alive], lowest[lowest != NONE], count[lowest != NONE]
            if not len(sym):
                break
        hit = rank == np.repeat(lowest, count)
        # Of touching hits (a a a) only every other one can merge, from the left.
        if (hit[1:] & hit[:-1]).any():
            start = hit & ~np.r_[False, hit[:-1]]
            place = np.arange(len(hit))
            begun = np.maximum.accumulate(np.where(start, place, -1))
            hit &= (place - begun) % 2 == 0
        at = np.flatnonzero(hit)
        sym = sym.copy()
        sym[at] = rank[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    owner, out = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(owner, kind="stable")
    return out[order], np.bincount(owner, minlength=len(words))


def encode_batch(texts: list[str | None], table: dict, known: dict[str, int], store: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and each text's count. known and store carry words from batch to batch."""
    import regex

    fast, full = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
    cut = [(fast(t) if t.isascii() else full(t)) if t else [] for t in texts]
    fresh = sorted(set().union(*cut) - known.keys())
    if fresh:
        ids, size = merge_rounds([w.encode("utf-8", "surrogatepass") for w in fresh], table)
        for w in fresh:
            known[w] = len(known)
        flat, starts, counts = store
        store[0] = np.concatenate([flat, ids.astype(np.int32)])
        store[1] = np.concatenate([starts, len(flat) + np.cumsum(size) - size])
        store[2] = np.concatenate([counts, size])
    flat, starts, counts = store
    n = sum(map(len, cut))
    get = known.__getitem__
    word = np.fromiter((get(w) for c in cut for w in c), dtype=np.int64, count=n)
    size = counts[word]
    total = int(size.sum())
    end = np.cumsum(size)
    at = np.repeat(starts[word] - (end - size), size) + np.arange(total)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
    return flat[at], np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, known_words: int = 300_000) -> DataFrame:
    """One row per row of ``df``: ``id_col`` and ``ids``, the ids of ``text_col``.

    Null and empty texts give an empty list, never null; blanks are text. Special
    tokens are never made. Repeated rows give repeated rows; a null id stays null;
    other columns are ignored. ``known_words`` bounds a task's memory of encoded
    words (it is emptied when full; the result doesn't depend on it). No shuffle.
    """
    table = df.sparkSession.sparkContext.broadcast(pair_table(load_ranks(vocabulary)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict[str, int] = {}
        empty = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
        store = list(empty)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if len(known) > known_words:
                    known.clear()
                    store[:] = empty
                ids, size = encode_batch(part.column(1).to_pylist(), table.value, known, store)
                ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p6_ids": p6_ids}


def oracle_sql() -> dict:
    return {}
