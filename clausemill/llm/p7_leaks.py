"""Problem 7: passages of test items inside the corpus, by pigeonhole and Myers.

A passage of ``window`` item words with at most ``errors`` of them changed, dropped or
added is cut into ``errors + 1`` pieces; one of them stands unharmed, so a run of
``ceil((window - errors) / (errors + 1))`` words is exact. Blocks of half that run,
laid over the item from its start, are looked up at every place of a text; where enough
different blocks of one item lie on neighbouring diagonals, windows of the item are
verified with Myers' bit-parallel distance over words.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import read

WORD = r"[a-z0-9]+"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def myers_at_most(pattern: list[int], text: list[int], limit: int) -> bool:
    """Whether some stretch of ``text`` is within ``limit`` edits of ``pattern`` (at most 64 symbols a word isn't required)."""
    m = len(pattern)
    if m <= limit:
        return True
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in text:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= limit:
            return True
        ph = (ph << 1) & full  # a stretch may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return False


def block_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for the ``size`` words at every place (equal words, equal keys; verified later)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key = (key ^ ids[k : k + n].astype(np.uint64)) * np.uint64(MIX[0])
        key ^= key >> np.uint64(31)
    return key


class ItemIndex:
    """Blocks of all items of one bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors = window, errors
        run = -(-(window - errors) // (errors + 1))
        self.size = max(1, run // 2)
        self.least = max(1, (window - self.size + 1) // self.size - errors)
        vocabulary: dict[str, int] = {}
        self.words: list[list[int]] = []
        self.ids: list[int] = []
        for item, text in items:
            words = re.findall(WORD, (text or "").lower())
            if item is None or len(words) < window:
                continue
            self.ids.append(item)
            self.words.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words])
        self.vocabulary = vocabulary
        keys, owner, block = [], [], []
        for i, words in enumerate(self.words):
            k = block_keys(np.array(words), self.size)[:: self.size]
            keys.append(k)
            owner.append(np.full(len(k), i))
            block.append(np.arange(len(k)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
        self.keys, self.owner, self.block = cat(keys, np.uint64), cat(owner, np.int64), cat(block, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner, self.block = self.keys[order], self.owner[order], self.block[order]

    def find(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place of the text, item id) of every leak."""
        if not len(self.keys):
            return []
        get, find = self.vocabulary.get, re.compile(WORD).findall
        cut = [find(t.lower()) if t else () for t in texts]
        length = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        ids = np.fromiter((get(w, 0) for c in cut for w in c), dtype=np.int64, count=int(length.sum()))
        ends = np.cumsum(length)
        text = np.repeat(np.arange(len(texts)), length)
        size = self.size
        if len(ids) < size:
            return []
        known = np.r_[0, np.cumsum(ids > 0)]
        at = np.flatnonzero((known[size:] - known[:-size] == size) & (text[size - 1 :] == text[: len(text) - size + 1]))
        if not len(at):
            return []
        key = block_keys(ids, size)[at]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return []
        place = np.repeat(at, n)
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, block, doc = self.owner[entry], self.block[entry], text[place]
        diagonal = place - block * size
        found: set[tuple[int, int]] = set()
        # Bands of twice the error budget, at two offsets: blocks of one passage share one of them.
        width = 2 * self.errors + 1
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for shift in (0, self.errors):
            band = (diagonal + shift) // width
            order = np.lexsort((block, band, owner, doc))
            d, o, b, k = doc[order], owner[order], band[order], block[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (b[1:] != b[:-1])]
            fresh = new | np.r_[True, k[1:] != k[:-1]]
            start = np.flatnonzero(new)
            enough = np.add.reduceat(fresh.astype(np.int64), start) >= self.least
            stop = np.r_[start[1:], len(order)]
            for s, e in zip(start[enough], stop[enough], strict=True):
                pairs[int(d[s]), int(o[s])] += zip(place[order[s:e]].tolist(), k[s:e].tolist(), strict=True)
        for (d, o), hits in pairs.items():
            if self._verify(ids, int(ends[d] - length[d]), int(ends[d]), self.words[o], sorted(set(hits))):
                found.add((d, o))
        return [(d, self.ids[o]) for d, o in sorted(found)]

    def _verify(self, ids: np.ndarray, begin: int, end: int, words: list[int], hits: list[tuple[int, int]]) -> bool:
        """Windows of the item around the hits, those with most hit blocks first."""
        blocks = sorted({b for _, b in hits})
        tries: dict[int, int] = {}
        for b in blocks:
            for a in range(max(0, (b + 1) * self.size - self.window), min(b * self.size, len(words) - self.window) + 1):
                tries[a] = tries.get(a, 0) + 1
        slack = self.window + 2 * self.errors
        for a, n in sorted(tries.items(), key=lambda x: (-x[1], x[0])):
            if n < self.least:
                break
            near = [p - (b * self.size - a) for p, b in hits if a <= b * self.size <= a + self.window - self.size]
            if not near:
                continue
            pattern = words[a : a + self.window]
            for lo in sorted({(p // self.window) * self.window for p in near}):
                stretch = ids[max(begin, lo - slack) : min(end, lo + self.window + 2 * slack)].tolist()
                if myers_at_most(pattern, stretch, self.errors):
                    return True
        return False


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 30, errors: int = 2, block: int = 5000) -> DataFrame:
    """(``doc_id``, ``item_id``) for each text that holds ``window`` item words with at most ``errors`` edits.

    Words are runs of a-z and 0-9 of the lower-cased text. Null, empty and short texts
    or items give no row; a leak found in repeated rows comes once; rows with a null id
    are left out; other columns are ignored. The items travel to the executors in blocks
    of ``block`` items (one pass of the corpus each); the corpus itself isn't shuffled,
    only the links found are, to drop repeats.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    wanted = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    blocks = -(-wanted.count() // block) or 1
    result = None
    for n in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in part.collect()], window, errors))

        def run(batches, index=index):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    rows = batch.slice(at, 2000)
                    found = index.value.find(rows.column(1).to_pylist())
                    if found:
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([d for d, _ in found])), pa.array([i for _, i in found], type=pa.int64() if item_kind == "bigint" else None)], names=[doc_id, item_id])

        now = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text).mapInArrow(run, f"`{doc_id}` {doc_kind}, `{item_id}` {item_kind}")
        result = now if result is None else result.unionByName(now)
    return result.dropDuplicates([doc_id, item_id])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def queries() -> dict:
    return {"p7_found": p7_found}


def oracle_sql() -> dict:
    return {}
