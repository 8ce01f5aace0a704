"""Problem 5: most similar vectors of every vector, by additive quantisation.

A vector is written as a sum of full-dimensional codewords, one of each of several
residual codebooks, found by beam search. The nearest word of the first codebook also
names the vector's cell. A query looks into its own cell and those whose boundary is near
it, scores the members there by lookup tables over the codes, held against a bound from
each member's stored norms, and reranks what passes by the exact cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.session import materialise, read


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(p @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for p in np.array_split(x, -(-len(x) // 8192))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


def beam_encode(x: np.ndarray, books: list[np.ndarray], beam: int) -> np.ndarray:
    """The codes (rows, codebooks) of the best sum that the beam holds at the end."""
    n, rest, err = len(x), x[:, None, :], np.zeros((len(x), 1), dtype=np.float32)
    codes = np.zeros((n, 1, 0), dtype=np.int32)
    row = np.arange(n)[:, None]
    for book in books:
        cost = (err[:, :, None] + (book * book).sum(1) - 2.0 * (rest @ book.T)).reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
        parent, word = best // len(book), best % len(book)
        err = cost[row, best]
        rest = rest[row, parent] - book[word]
        codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.int32)], axis=2)
    return codes[np.arange(n), err.argmin(1)]


def train(sample: np.ndarray, cells: int, words: int, levels: int, beam: int, seed: int = 7) -> list[np.ndarray]:
    """Residual codebooks, then one joint least-squares step over all words (all of full dimension)."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    books = [_kmeans(x, min(cells, len(x)), 6, seed)]
    small = x[: 64 * words]
    for level in range(levels):
        codes = beam_encode(small, books, beam)
        rest = small - sum(b[codes[:, i]] for i, b in enumerate(books))
        books.append(_kmeans(rest.astype(np.float32), min(words, len(rest)), 6, seed + level + 1))
    # The words after the first codebook are fitted together to what the first leaves.
    codes = beam_encode(small, books, beam)
    offset = np.cumsum([0] + [len(b) for b in books[1:]])
    if offset[-1]:
        a = np.zeros((len(small), offset[-1]), dtype=np.float32)
        for i in range(len(books) - 1):
            a[np.arange(len(small)), offset[i] + codes[:, i + 1]] = 1
        flat = np.concatenate(books[1:])
        rest = small - books[0][codes[:, 0]] - a @ flat
        flat = flat + np.linalg.solve(a.T @ a + np.eye(offset[-1]), a.T @ rest)
        books[1:] = [flat[s:e].astype(np.float32) for s, e in zip(offset[:-1], offset[1:], strict=True)]
    return books


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def neighbours(df: DataFrame, id_col: str = "clause_id", vector: str = "embedding", k: int = 5, floor: float = 0.9, dim: int = 64, margin: float = 0.055, per_cell: int = 2048, levels: int = 7, words: int = 64, beam: int = 4, deviations: float = 2.5, chunk: int = 8192, most: int = 1_000_000) -> DataFrame:
    """Directed links (src, dst, cosine): of each vector the ``k`` most similar others with cosine >= ``floor``.

    Null ids, null vectors, vectors of another dimension, with a null or non-finite
    number, and all-zero vectors are left out. Rows that repeat an id count once. Equal
    vectors are searched once, by the least id of theirs; each of them gets links to
    its copies first. Ties in cosine go to the lesser id. Other columns are ignored.
    The codebooks are fitted on a sample of at most 32 rows a cell (4096 cells at most);
    all rows are indexed and all are queries. A cell that the sample shows to be larger
    than ``chunk`` rows is split into chunks, so that no task holds an unbounded cell.
    Groups of equal vectors are broadcast up to ``most`` (24 MB), joined beyond. There are
    ``n / per_cell`` cells, at least 256, but one for fewer than 4096 vectors.
    """
    spark = df.sparkSession
    v = F.col(vector)
    usable = (
        df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e30)) & F.exists("v", lambda x: x != 0))
        .withColumn("h", F.xxhash64("v"))
    )
    # Groups of equal vectors, from hashes and ids alone: the vectors aren't shuffled for it.
    groups = materialise(usable.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    n = groups.count()
    several = groups.where(F.col("last") != F.col("id")).select("h", F.col("id").alias("rep"))
    few = several.count() <= most
    single = usable.join(F.broadcast(several) if few else several, "h", "left").where("rep is null or rep = id").select("id", "v")
    cells = 1 if n < 4096 else 256
    while n >= 4096 and cells < min(4096, n // per_cell):
        cells *= 2
    wanted = 32 * max(cells, 512)
    share = min(1.0, 1.2 * wanted / max(n, 1))
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(wanted).toArrow()
    x = np.asarray(sample.column("v").combine_chunks().flatten(), dtype=np.float32).reshape(-1, dim) if n else np.zeros((0, dim), np.float32)
    schema = "src long, dst long, cosine double"
    if not len(x):
        return spark.createDataFrame([], schema)
    books = train(x, cells, words, levels, beam)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    load = np.bincount(np.concatenate([(p @ books[0].T - 0.5 * (books[0] ** 2).sum(1)).argmax(1) for p in np.array_split(unit, -(-len(unit) // 8192))]), minlength=len(books[0]))
    salts = np.maximum(1, np.ceil(load / len(x) * n / chunk)).astype(np.int64)
    shared = spark.sparkContext.broadcast((books, salts))

    def place(batches):
        books, salts = shared.value
        first = books[0]
        half = 0.5 * (first * first).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = part.column(0).to_numpy()
                raw = np.asarray(part.column(1).flatten(), dtype=np.float32).reshape(-1, dim)
                if not len(ids):
                    continue
                x = (raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
                codes = beam_encode(x, books, beam)
                near = x @ first.T - half
                home = near.argmax(1)
                gap = near[np.arange(len(x)), home][:, None] - near
                own = first[home]
                apart = np.sqrt(np.maximum((own * own).sum(1)[:, None] + 2 * half - 2 * (own @ first.T), 1e-12))
                probe = gap <= margin * apart
                probe[np.arange(len(x)), home] = False
                sums = sum(b[codes[:, i]] for i, b in enumerate(books))
                along = (x * sums).sum(1)
                off = np.sqrt(np.maximum((sums * sums).sum(1) - along * along, 0))
                # x.y >= floor makes y.sum at least this, but for a chance beyond so many deviations at the floor itself.
                least = floor * along - deviations * np.sqrt(max(0.0, 1 - floor * floor) / (dim - 1)) * off
                salt = (ids * 2654435761 % 2**31) % salts[home]
                q, c = np.nonzero(probe)
                rows = [(np.arange(len(x)), home, salt, np.ones(len(x), bool))]
                for s in range(int(salts.max())):
                    own_other = np.flatnonzero((salts[home] > s) & (salt != s))
                    rows.append((own_other, home[own_other], np.full(len(own_other), s), np.zeros(len(own_other), bool)))
                    there = salts[c] > s
                    rows.append((q[there], c[there], np.full(int(there.sum()), s), np.zeros(int(there.sum()), bool)))
                who, cell, slot, member = (np.concatenate(z) for z in zip(*rows, strict=True))
                data = [r.tobytes() for r in raw]
                code = [r.astype(np.int16).tobytes() for r in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int32)),
                        pa.array(slot.astype(np.int32)),
                        pa.array(ids[who].astype(np.int64)),
                        pa.array([data[i] for i in who], type=pa.binary()),
                        pa.array([code[i] if m else None for i, m in zip(who, member, strict=True)], type=pa.binary()),
                        pa.array(least[who].astype(np.float32)),
                    ],
                    names=["cell", "slot", "id", "v", "code", "least"],
                )

    def search(table: pa.Table) -> pa.Table:
        books, _ = shared.value
        ids = table.column("id").to_numpy()
        raw = _matrix(table.column("v"), dim).astype(np.float64)
        exact = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        x = exact.astype(np.float32)
        code = table.column("code")
        m = np.flatnonzero(code.is_valid().to_numpy())
        out: list[np.ndarray] = []
        if len(m) and len(ids) > 1:
            codes = np.frombuffer(b"".join(code.drop_null().to_pylist()), dtype=np.int16).reshape(len(m), -1)
            least = table.column("least").to_numpy()[m]
            used = [np.unique(codes[:, i], return_inverse=True) for i in range(codes.shape[1])]
            for at in range(0, len(ids), 1024):
                score = np.zeros((len(ids[at : at + 1024]), len(m)), dtype=np.float32)
                for (word, inverse), book in zip(used, books, strict=True):
                    score += np.take(x[at : at + 1024] @ book[word].T, inverse, axis=1)
                q, w = np.nonzero(score >= least)
                q, w = q + at, m[w]
                other = ids[q] != ids[w]
                q, w = q[other], w[other]
                cosine = np.einsum("ij,ij->i", exact[q], exact[w])
                good = cosine >= floor
                q, w, cosine = q[good], w[good], cosine[good]
                out.append(np.rec.fromarrays([np.r_[ids[q], ids[w]], np.r_[ids[w], ids[q]], np.r_[cosine, cosine]], names="s,d,c"))
        e = np.concatenate(out) if out else np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names="s,d,c")
        order = np.lexsort((e["d"], -e["c"], e["s"]))
        e = e[order]
        if len(e):
            e = e[np.r_[True, (e["s"][1:] != e["s"][:-1]) | (e["d"][1:] != e["d"][:-1])]]
            begin = np.flatnonzero(np.r_[True, e["s"][1:] != e["s"][:-1]])
            e = e[np.arange(len(e)) - np.repeat(begin, np.diff(np.r_[begin, len(e)])) < k]
        return pa.table({"src": pa.array(e["s"]), "dst": pa.array(e["d"]), "cosine": pa.array(e["c"])})

    placed = single.mapInArrow(place, "cell int, slot int, id long, v binary, code binary, least float")
    links = placed.groupBy("cell", "slot").applyInArrow(search, schema)
    best = W.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    links = links.repartition("src").groupBy("src", "dst").agg(F.max("cosine").alias("cosine"))
    links = links.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return _with_copies(links, usable, several, k)


def _with_copies(links: DataFrame, usable: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """Links of all ids, from the links of the least id of each group of equal vectors."""
    members = usable.select("h", "id").join(several, "h").select("rep", "id").dropDuplicates()
    # The first k+1 copies serve as neighbours; the window's group limit cuts hot groups before the shuffle.
    first = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("copy"))
    wide = links.join(first, F.col("dst") == F.col("rep"), "left").select("src", F.coalesce("copy", "dst").alias("dst"), "cosine")
    own = first.select(F.col("rep").alias("src"), F.col("copy").alias("dst"), F.lit(1.0).alias("cosine"))
    options = wide.unionByName(own)
    spread = options.join(members, F.col("src") == F.col("rep"), "left").select(F.coalesce("id", "src").alias("src"), "dst", "cosine").where("src != dst")
    best = W.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return spread.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "clause_vec").where("embed_model = 'clausenc-v2@64'")
    e = neighbours(vectors)
    return e.select(F.least("src", "dst").alias("clause_a"), F.greatest("src", "dst").alias("clause_b")).dropDuplicates()


def queries() -> dict:
    return {"p5_found": p5_found}


def oracle_sql() -> dict:
    return {}
