"""Problem 2: records alike beyond a floor, by an exact join in the metric space of Jaccard.

Whole records make poor pivots here: of unlike records nearly all lie between 0.85 and 1
from any pivot, so that no window of 0.4 parts them (see README). The pivots are therefore
the smallest sets, single shingles: a record lies at 1 - 1/n of each shingle that it has and
at 1 of all others. Its nearest pivots are its own shingles, the rarer first, and by the
triangle inequality two records within the radius share one of the first
n - least common + 1 of them; those windows say into which regions a record is copied.
Inside a region the distances to the empty set (sizes), the places of the pivots and a
lower bound of the symmetric difference (parity sketches) prune pairs; what is left is
verified over the whole sets. A pivot too common for one region is split again by the
second shared shingle, so that regions join recursively and exactly.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.shingles import BITS, mix, shingle_hashes, shingle_sets, slices
from clausemill.session import materialise, read

TABLE = 20  # bits of the frequency table: of fixed size, whatever the corpus; what strangers add to a number is taken off (see spread)
CUTS = 16


class Bounds:
    """Exact whole-number bounds for Jaccard >= a/b."""

    def __init__(self, floor: float):
        f = Fraction(floor).limit_denominator(1000)
        self.a, self.b = f.numerator, f.denominator

    def common(self, total):
        """Least number of common members of two sets with ``total`` members together."""
        return -(-self.a * total // (self.a + self.b))

    def probe(self, n):
        """First pivots to look into for any partner."""
        return n + (-self.a * n // self.b) + 1

    def index(self, n):
        """First pivots for partners of at least the same size."""
        return n - self.common(2 * n) + 1

    def largest(self, n):
        return self.b * n // self.a


def frequencies(df: DataFrame, width: int) -> np.ndarray:
    """How often each of 2**TABLE hash values of shingles stands in all texts of ``df`` (id, text)."""

    def count(batches):
        table = np.zeros(1 << TABLE, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                s, _, _ = shingle_hashes(texts[a:b], width)
                table += np.bincount((s & np.uint64((1 << TABLE) - 1)).astype(np.int64), minlength=1 << TABLE)
        if table.any():
            data = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(table, CUTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CUTS, dtype=np.int32)), pa.array(data, type=pa.binary())], names=["cut", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in table.column("data").to_pylist())
        return pa.table({"cut": table.column("cut").slice(0, 1), "data": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], type=pa.binary())})

    rows = df.select("text").mapInArrow(count, "cut int, data binary").groupBy("cut").applyInArrow(add, "cut int, data binary").collect()
    out = np.zeros(1 << TABLE, dtype=np.int32)
    for r in rows:
        out[r.cut * (1 << TABLE) // CUTS : (r.cut + 1) * (1 << TABLE) // CUTS] = np.frombuffer(r.data, dtype=np.int32)
    return out


def _pairs(tok, doc, n, ids, rank, index, sketch, bounds: Bounds, block: int):
    """Pairs of documents of one region table that no bound excludes."""
    order = np.lexsort((ids[doc], n[doc], tok))
    tok, doc, rank, index = tok[order], doc[order], rank[order], index[order]
    size = n[doc]
    group = np.cumsum(np.r_[True, tok[1:] != tok[:-1]]) - 1
    wide = int(size.max()) + 2
    key = group * wide + size
    last = np.searchsorted(key, group * wide + np.minimum(bounds.largest(size), wide - 1), "right")
    count = np.where(index, last - np.arange(len(tok)) - 1, 0)
    todo = np.flatnonzero(count > 0)
    total = np.cumsum(count[todo])
    out = []
    at = 0
    while at < len(todo):  # blocks of pairs, so that a large region needs no more memory
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + block, "right")))
        some = todo[at:to]
        at = to
        c = count[some]
        p = np.repeat(some, c)
        q = p + 1 + (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c))
        t = bounds.common(size[p] + size[q])
        ok = np.minimum(size[p] - rank[p], size[q] - rank[q]) >= t
        p, q, t = p[ok], q[ok], t[ok]
        dp, dq = doc[p], doc[q]
        apart = np.bitwise_count(sketch[dp, 0] ^ sketch[dq, 0]).astype(np.int64) + np.bitwise_count(sketch[dp, 1] ^ sketch[dq, 1])
        ok = (apart <= size[p] + size[q] - 2 * t) & (ids[dp] != ids[dq])
        dp, dq = dp[ok], dq[ok]
        if len(dp):
            pair = np.unique(np.c_[np.minimum(ids[dp], ids[dq]), np.maximum(ids[dp], ids[dq])], axis=0)
            out.append(pair)
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)


def candidates(df: DataFrame, floor: float, width: int, least_words: int, table: np.ndarray, hot: int) -> DataFrame:
    """(a, b): pairs of ids that share a region and pass its bounds. df: (id long, text)."""
    spark = df.sparkSession
    regions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = Bounds(floor)
    # A number of the table counts all shingles of its hash: their mean, on a corpus of any size, isn't a shingle's own.
    strangers = int(table.mean())
    shared = spark.sparkContext.broadcast(table)
    names = ["region", "ids", "n", "sketch", "tok", "doc", "rank"]

    def spread(batches):
        often = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            every = batch.column(0).to_numpy()
            for a, b in slices(texts, 4 << 20, 16384):
                s, text, words = shingle_sets(texts[a:b], width)
                keep = words[text] >= least_words
                s, text = s[keep], text[keep]
                if not len(s):
                    continue
                freq = np.minimum(often[(s & np.uint64((1 << TABLE) - 1)).astype(np.int64)], (1 << 30) - 1).astype(np.int64)
                order = np.argsort((text << 32) | freq, kind="stable")  # by text, rarity, hash
                s, text, freq = s[order], text[order], freq[order]
                first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                n = np.diff(np.r_[first, len(text)])
                local = np.repeat(np.arange(len(first)), n)
                rank = np.arange(len(s)) - np.repeat(first, n)
                other = mix(s ^ np.uint64(0x5DEECE66D))
                bit = np.left_shift(np.uint64(1), other & np.uint64(63))
                half = (other >> np.uint64(6)) & np.uint64(1)
                sketch = np.stack([np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), first) for h in (0, 1)], axis=1)
                size = n[local]
                far, near = bounds.probe(size), bounds.index(size)
                # Common pivots: by the pair with the next shared one, which lies at most one place beyond the window.
                single = np.flatnonzero((rank < far) & (freq - strangers <= hot))
                toks, docs, ranks, roles = [mix(s[single])], [local[single]], [rank[single]], [rank[single] < near[single]]
                common = np.flatnonzero((rank < far) & (freq - strangers > hot))
                for step in range(1, int(far.max()) + 1) if len(common) else ():
                    c = common[rank[common] + step < np.minimum(far[common] + 1, size[common])]
                    if not len(c):
                        break
                    toks.append(mix(s[c] * np.uint64(3) + s[c + step]))
                    docs.append(local[c])
                    ranks.append(rank[c])
                    roles.append((rank[c] < near[c]) & (rank[c + step] < near[c] + 1))
                # A second shared pivot needs at least two common members; lesser sets meet by the first alone.
                few = common[bounds.common(2 * size[common]) < 2]
                toks.append(mix(s[few]))
                docs.append(local[few])
                ranks.append(rank[few])
                roles.append(np.ones(len(few), bool))
                tok, doc, rk, role = (np.concatenate(x) for x in (toks, docs, ranks, roles))
                region = (tok % np.uint64(regions)).astype(np.int64)
                order = np.argsort(region, kind="stable")
                ends = np.searchsorted(region[order], np.arange(regions + 1))
                ids = every[a:b][text[first]]
                rows = []
                for r in range(regions):
                    o = order[ends[r] : ends[r + 1]]
                    if len(o):
                        here, inverse = np.unique(doc[o], return_inverse=True)
                        rows.append((r, ids[here].astype(np.int64).tobytes(), n[here].astype(np.int32).tobytes(), sketch[here].tobytes(), (tok[o] >> np.uint64(32)).astype(np.uint32).tobytes(), inverse.astype(np.uint16).tobytes(), (rk[o].astype(np.uint32) * 2 + role[o]).astype(np.uint32 if rk.max() > 30000 else np.uint16).tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int32())] + [pa.array(x, type=pa.binary()) for x in cols[1:]], names=names)

    def join(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(row[0], []).append(row[1:])
        for rows in parts.values():
            ids = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
            n = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows]).astype(np.int64)
            sketch = np.concatenate([np.frombuffer(r[2], np.uint64).reshape(-1, 2) for r in rows])
            tok = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            base = np.cumsum([0] + [len(r[0]) // 8 for r in rows])
            doc = np.concatenate([np.frombuffer(r[4], np.uint16).astype(np.int64) + x for r, x in zip(rows, base, strict=False)])
            code = np.concatenate([np.frombuffer(r[5], np.uint16 if len(r[5]) * 2 == len(r[3]) else np.uint32).astype(np.int64) for r in rows])
            pair = _pairs(tok, doc, n, ids, code >> 1, (code & 1).astype(bool), sketch, bounds, 1 << 21)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    kinds = "region int, ids binary, n binary, sketch binary, tok binary, doc binary, rank binary"
    placed = df.select("id", "text").mapInArrow(spread, kinds).repartitionById(regions, F.col("region"))
    return placed.mapInArrow(join, "a long, b long").dropDuplicates()


def verify(pairs: DataFrame, df: DataFrame, floor: float, width: int, most: int = 2_000_000) -> DataFrame:
    """(a, b, common, size_a, size_b): the pairs whose whole sets overlap by the floor."""
    spark = df.sparkSession
    bounds = Bounds(floor)
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).dropDuplicates())
    if wanted.count() <= most:  # 16 MB at most; beyond that, a join
        ids = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("id").to_numpy()))
        some = df
    else:
        ids, some = None, df.join(wanted, "id", "left_semi")

    def sets(batches):
        for batch in batches:
            mine = batch.column(0).to_numpy()
            if ids is not None:
                at = np.minimum(np.searchsorted(ids.value, mine), max(0, len(ids.value) - 1))
                keep = np.flatnonzero(ids.value[at] == mine) if len(ids.value) else np.zeros(0, np.int64)
                batch, mine = batch.take(pa.array(keep)), mine[keep]
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                s, text, _ = shingle_sets(texts[a:b], width)
                ends = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(mine[a:b]), pa.array([s[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], type=pa.binary())], names=["id", "s"])

    whole = some.select("id", "text").mapInArrow(sets, "id long, s binary").dropDuplicates(["id"])

    def check(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            common = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            na, nb = (np.array([len(p) // 8 for p in z.to_pylist()], dtype=np.int64) for z in (x, y))
            c = np.array(common, dtype=np.int64)
            ok = pa.array(np.flatnonzero(c >= bounds.common(na + nb)))
            yield pa.RecordBatch.from_arrays([a.take(ok), b.take(ok), pa.array(c).take(ok), pa.array(na).take(ok), pa.array(nb).take(ok)], names=["a", "b", "common", "size_a", "size_b"])

    joined = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, common long, size_a long, size_b long")


def copies(df: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows to join, members): groups of equal texts are joined by their least id alone.

    ``df``: (id, text). Groups are made from two 64-bit hashes of the text, counted
    before the shuffle; members is (rep, id) of the groups of several ids whose text
    has ``least_words``. The texts aren't shuffled where the groups' hashes fit a
    broadcast of a million rows.
    """
    rows = df.select("id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g"))
    groups = materialise(rows.groupBy("h", "g").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last"))
    side = F.broadcast(groups) if groups.count() <= 1_000_000 else groups
    joined = rows.join(side, ["h", "g"], "left")
    # Words are counted for members only: the pattern is dear, and all other texts are cut in the join anyway.
    words = F.size(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    members = rows.join(side, ["h", "g"]).where(words >= least_words).select("rep", "id").dropDuplicates()
    return joined.where("rep is null or rep = id").select("id", "text"), members


def linked(df: DataFrame, id_col: str, text: F.Column, floor: float, width: int, least_words: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of representatives with counts, members of groups of copies, all rows)."""
    base = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id is not null and text is not null")
    single, members = copies(base, least_words)
    pairs = materialise(candidates(single, floor, width, least_words, frequencies(base, width), hot))
    return verify(pairs, single, floor, width), members, base


def alike(df: DataFrame, id_col: str, text: F.Column, floor: float = 0.8, width: int = 5, least_words: int = 5, hot: int = 50_000) -> DataFrame:
    """Pairs (a < b) of rows whose texts share at least ``floor`` of their distinct runs of ``width`` words.

    Exact: no cap, no sampling. Null ids and null texts are left out; texts with fewer
    than ``least_words`` words (so the empty ones) pair with none; rows that repeat an id
    must be alike and count once. Other columns are ignored. Only hashes travel between
    executors; the frequency table has a fixed 2**20 entries. A shingle that stands in
    more than ``hot`` places is split by the next shared one. Copies (equal texts) are
    joined once and expanded at the end, so that a large group of them costs no more than
    the rows it yields; where those aren't wanted, use classes().
    """
    links, members, _ = linked(df, id_col, text, floor, width, least_words, hot)
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    wide = links.select("a", "b").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("p"), F.coalesce("y", "b").alias("q"))
    same = left.withColumnRenamed("a", "b").join(right, "b").where("x < y").select(F.col("x").alias("p"), F.col("y").alias("q"))
    return wide.unionByName(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def classes(df: DataFrame, id_col: str, text: F.Column, floor: float = 0.8, width: int = 5, least_words: int = 5, hot: int = 50_000) -> DataFrame:
    """(id, class_id, links): one row an id; class_id is the least id with the same text, links the number of other ids alike.

    Nothing is expanded: sizes of groups are summed over the pairs of representatives.
    Ids of null or short texts are classes of their own without links.
    """
    links, members, base = linked(df, id_col, text, floor, width, least_words, hot)
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    more = both.join(size.withColumnRenamed("rep", "other"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("near"))
    ids = base.select("id").dropDuplicates().join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = ids.join(size, "rep", "left").join(more, "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("near", F.lit(0))).alias("links"))


def _text() -> F.Column:
    return F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alike(read(spark, sf_dir, "clauses"), "clause_id", _text(), floor=0.6, width=3, least_words=30)
    return found.select(F.col("a").alias("clause_a"), F.col("b").alias("clause_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clause with its class of copies and its number of links at five words and 0.8."""
    found = classes(read(spark, sf_dir, "clauses"), "clause_id", _text())
    return found.withColumnRenamed("id", "clause_id")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_classes": p2_classes}


def oracle_sql() -> dict:
    return {}
