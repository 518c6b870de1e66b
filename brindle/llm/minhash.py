"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is its bag of shingles of five words (`[^\\x20\\x09-\\x0D]+`); a document of one to four
words has one shingle of all of them. Copy i of a shingle is the strip [i, i + 1) of the shingle's
weight region. Darts are thrown into (strip, rank) cells by hashing: a Poisson number of darts a cell,
each with a rank and a coordinate. The dart of lowest rank at each of `t` coordinates is the
signature, so two signatures agree at a coordinate with the probability of their weighted Jaccard
similarity. Only as many cells are opened as a document's weight needs, so long documents throw no more
darts than short ones.

Frequent keys of the inner joins (a band or a hub of many nodes) are left to Spark's adaptive skew join, which splits them once they are
large; the join of all rows to their classes spreads frequent texts itself.

Equal texts are one node. Nodes that share a band are candidates. In each shared band every node is
paired with the band's hub, the member whose bands are shared most; pairs are verified on the exact
weighted Jaccard similarity and verified links joined to components. A band that then still spans
several components is searched in blocks of bounded size for other similar pairs, which are verified on the same
similarity inside the task, so links that do not run through a hub are kept and no pairs are listed. A pair of similarity 0.8 shares none of the 32 bands of 4 with
a probability of 5e-8.

Nodes are 64-bit hashes of whole texts. Nulls and texts without words are classes of their own. A null
id never is a class id unless all ids of the class are null. Repeated rows share a class. An empty table
gives an empty result. Extra columns are carried; columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ROW, U64, as_long, checkpointed, column, kept_columns, mapped, mix64, named, packed, record, reuse_memory, sorted_runs, spread_join, text_slices, unpacked, word_hashes
from .components import connected_components

WORDS = 5
COORDINATES = 128
BANDS = 32
FIRST_CELL = -12  # ranks below 2^-12 are the first cell; each further cell doubles the rank
BLOCK_ROWS = 2048
SLICE_BYTES = 1 << 18  # of text signed at once; its darts are many times that where texts are short


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows of a slice in order, and the row of each."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    last = np.repeat(first[1:], n)
    padded = np.concatenate([hashes, np.zeros(WORDS, U64)])
    at = np.arange(len(hashes))
    out = np.zeros(len(hashes), U64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            out = mix64(out + np.where(at + j < last, padded[j : j + len(hashes)], U64(0)) + U64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
    whole = (at + WORDS <= last) | (at == np.repeat(first[:-1], n))
    return out[whole], rows[whole]


def _strips(elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit strips of the weight regions: equal elements of a row are told apart by number."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix64(elements + rows.astype(U64) * U64(0xD6E8FEB86659FD93)), kind="stable")
        e, r = elements[order], rows[order]
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
        number = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
        return mix64(e + number.astype(U64) * U64(0xA0761D6478BD642F)), r


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def _poisson(width: float) -> np.ndarray:
    """Cumulative Poisson probabilities until they reach 1 in doubles."""
    p, total, out, k = np.exp(-width), 0.0, [], 0
    while total < 1 - 1e-15 and k < 10 * width + 60:
        total += p
        out.append(total)
        k += 1
        p *= width / k
    return np.array(out)


def dart_signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, t: int = COORDINATES) -> np.ndarray:
    """The rank of the earliest dart at each coordinate, as bits, for each row; rows without elements get 2^64 - 1."""
    strips, owner = _strips(elements, rows)
    weight = np.bincount(owner, minlength=n_rows)
    best = np.full(n_rows * t, np.inf)
    goal = t * (np.log(t) + 2.0) / np.maximum(weight, 1)
    cell = 0
    open_rows = weight > 0
    with np.errstate(over="ignore"):
        while open_rows.any():
            lo = 0.0 if cell == 0 else 2.0 ** (FIRST_CELL + cell - 1)
            hi = 2.0 ** (FIRST_CELL + cell)
            mine = open_rows[owner]
            s, o = (strips, owner) if mine.all() else (strips[mine], owner[mine])
            h = mix64(s + U64((cell + 1) * 0xE7037ED1A0B428DB % 2**64))
            table = _poisson(hi - lo)
            u = _unit(h)
            hit = np.flatnonzero(u >= table[0])
            darts = np.searchsorted(table, u[hit], side="right")
            h, o = np.repeat(h[hit], darts), np.repeat(o[hit], darts)
            number = np.arange(len(h)) - np.repeat(np.cumsum(darts) - darts, darts)
            d = mix64(h + (number.astype(U64) + U64(1)) * U64(0x8EBC6AF09C88C6E3))
            rank = lo + (hi - lo) * _unit(d)
            key = o * t + (mix64(d + U64(0x589965CC75374CC3)) % U64(t)).astype(np.int64)
            np.minimum.at(best, key, rank)
            reached = hi >= goal
            if reached.any():
                full = np.isfinite(best.reshape(n_rows, t)).all(axis=1)
                open_rows &= ~(reached & full)
            cell += 1
    best = best.reshape(n_rows, t)
    return np.where(np.isfinite(best), best.view(U64).reshape(n_rows, t), U64(2**64 - 1))


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, t = signatures.shape
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (n, bands)).copy()
    grouped = signatures.reshape(n, bands, t // bands)
    with np.errstate(over="ignore"):
        for j in range(t // bands):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return out


def _signed(docs: DataFrame, t: int, bands: int) -> DataFrame:
    """node, bands and one byte of each coordinate, for rows with words."""
    schema = pa.schema([("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            nodes = np.asarray(column(batch, "node"))
            for lo, hi, data, offsets in text_slices(column(batch, "text"), SLICE_BYTES):
                hashes, first = word_hashes(data, offsets)
                sig = dart_signatures(*shingles(hashes, first), hi - lo, t)
                keep = np.flatnonzero(np.diff(first))
                keys = as_long(band_keys(sig[keep], bands))
                flat = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
                low = (sig[keep] & U64(255)).astype(np.uint8).tobytes()
                packed = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.arange(len(keep) + 1, dtype=np.int32) * t), pa.py_buffer(low)])
                yield record(schema, nodes[lo:hi][keep], flat, packed)

    return docs.select("node", "text").transform(mapped(run, "node long, bands array<long>, sig binary"))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted bags."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    if not len(both):
        return 0.0

    def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, n = np.unique(x, return_counts=True)
        return values, n

    va, na = counted(a)
    vb, nb = counted(b)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[ia], nb[ib]).sum())
    return shared / (len(a) + len(b) - shared)


def _bags(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("bag", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(column(batch, "node"))
            for lo, hi, data, offsets in text_slices(column(batch, "text"), SLICE_BYTES):
                e, rows = shingles(*word_hashes(data, offsets))
                order = np.lexsort((e, rows))
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield record(schema, nodes[lo:hi], pa.ListArray.from_arrays(pa.array(bounds), pa.array(as_long(e[order]))))

    return docs.transform(mapped(run, "node long, bag array<long>"))


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose bags are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = column(batch, "bag_a"), column(batch, "bag_b")
            good = [i for i in range(batch.num_rows) if weighted_jaccard(x[i].values.to_numpy(), y[i].values.to_numpy()) >= threshold]
            yield record(schema, column(batch, "a").take(pa.array(good, pa.int64())), column(batch, "b").take(pa.array(good, pa.int64())))

    of = lambda c: bags.select(F.col("node").alias(c), F.col("bag").alias(f"bag_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "bag_a", "bag_b").transform(mapped(run, "a long, b long"))


def _candidates(sig: np.ndarray, keys: np.ndarray, no: np.ndarray, label: np.ndarray, side: np.ndarray, i: int, least: float) -> np.ndarray:
    """Rows after i, or of the other block, of another component whose signature agrees enough and that share no earlier band key with i."""
    rest = np.arange(i + 1, len(label)) if side[i] == 2 else np.flatnonzero(side == 1)
    rest = rest[label[rest] != label[i]]
    if not len(rest):
        return rest
    rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= least]
    return rest[~(keys[rest, : no[i]] == keys[i, : no[i]]).any(axis=1)]


def _links_in(sig: np.ndarray, keys: np.ndarray, no: np.ndarray, label: np.ndarray, side: np.ndarray, node: np.ndarray, bags: list[np.ndarray], least: float, threshold: float) -> list[tuple[int, int]]:
    """Links that join the components of one piece of work as far as its similar pairs do."""
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    flat = np.concatenate(bags)
    new = np.ones(len(flat), bool)
    first = np.cumsum(sizes) - sizes
    new[1:] = flat[1:] != flat[:-1]
    new[first[sizes > 0]] = True
    number = np.arange(len(flat)) - np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
    with np.errstate(over="ignore"):
        _, ids = np.unique(mix64(flat.view(U64) + number.astype(U64) * U64(0xA0761D6478BD642F)), return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    label, out = label.copy(), []
    for i in np.flatnonzero(side != 1):
        rest = _candidates(sig, keys, no, label, side, i, least)
        if not len(rest):
            continue
        mark[ids[first[i] : first[i] + sizes[i]]] = 1
        n = sizes[rest]
        at = np.arange(int(n.sum())) + np.repeat(first[rest] - (np.cumsum(n) - n), n)
        shared = np.add.reduceat(mark[ids[at]], np.cumsum(n) - n)
        mark[ids[first[i] : first[i] + sizes[i]]] = 0
        for j in rest[shared >= threshold * (n + sizes[i] - shared) - 1e-9]:
            if label[j] != label[i]:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def _pieces(rows: DataFrame, least: float, threshold: float | None) -> DataFrame:
    """With a threshold the links (a, b) of each piece of work; without it the rows that have a candidate at all."""
    row_schema = pa.schema([("piece", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("no", pa.int32()), ("side", pa.int32()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for table in sorted_runs(batches, "piece"):
            piece, node, label, no, side = (table.column(c).to_numpy() for c in ("piece", "node", "label", "no", "side"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
            keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(piece)]])
            links, wanted = [], np.zeros(len(node), bool)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                if threshold is not None:
                    bags = [x.values.to_numpy() for x in table.column("bag").slice(lo, hi - lo)]
                    links += _links_in(sig[lo:hi], keys[lo:hi], no[lo:hi], label[lo:hi], side[lo:hi], node[lo:hi], bags, least, threshold)
                else:
                    for i in np.flatnonzero(side[lo:hi] != 1):
                        if len(found := _candidates(sig[lo:hi], keys[lo:hi], no[lo:hi], label[lo:hi], side[lo:hi], i, least)):
                            wanted[lo + i] = True
                            wanted[lo + found] = True
            if threshold is None:
                yield from table.select(row_schema.names).filter(pa.array(wanted)).to_batches()
            elif links:
                yield record(link_schema, np.array([min(x) for x in links]), np.array([max(x) for x in links]))

    form = "piece long, node long, label long, no int, side int, sig binary, bands array<long>" if threshold is None else "a long, b long"
    return rows.repartition("piece").sortWithinPartitions("piece").transform(mapped(run, form))


def least_agreement(threshold: float, t: int, miss: float = 1e-9) -> float:
    """The share of t coordinates below which a pair of similarity `threshold` agrees with a probability of at most `miss`."""
    below = 0.0
    for k in range(t + 1):
        below += math.comb(t, k) * threshold**k * (1 - threshold) ** (t - k)
        if below > miss:
            return k / t
    return 1.0


def _other_links(shared: DataFrame, bags: DataFrame, threshold: float, t: int) -> DataFrame:
    """Links across components inside a band that hubs did not find; shared has the open bands with labels and signatures.

    A pair is looked at in the first band it shares by the band's whole key, on signatures that a pair at the threshold
    misses with a probability of 1e-9, and decided on the bags. Pairs stay inside a task; only links that join two components
    leave it. A band of more than BLOCK_ROWS members is dealt to blocks, and each pair of blocks is one piece of work, so
    no task holds more than two blocks of a band at once.
    """
    least = least_agreement(threshold, t)
    # side 2: both sides of the pair lie in this block; 0 and 1: the lower and the higher block
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).withColumn("mine", mine).withColumn("other", other)
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    piece = F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = dealt.select(piece.alias("piece"), "node", "label", F.col("no").cast("int").alias("no"), side.cast("int").alias("side"), "sig", "bands")
    wanted = checkpointed(_pieces(rows, least, None))
    return _pieces(wanted.join(bags, "node"), least, threshold).distinct()


def near_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id", carry: list[str] | None = None, threshold: float = 0.8, t: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """df's columns (or those in `carry`) with class_id, the least id of the row's class, node and n_links.

    n_links counts the spanning links found for the row's text: verified links to hubs, and those that joined two components.
    Similar texts already in one component are not linked again, so it is at most the number of similar texts and depends on the
    search order; class_id does not. The text itself is only moved
    for nodes that share a band.
    """
    made = {"class_id", "node", "n_links"}
    carry = kept_columns(df, carry, made)
    body = named(text)
    docs = df.select(packed(carry), named(row_id).alias("_id"), F.when(body.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(body)).alias("node"), body.alias("text"))
    ids = checkpointed(docs.select("_id", "node"))
    first = checkpointed(ids.where("node is not null").groupBy("node").agg(F.min("_id").alias("_first")))
    # every row is signed and copies are dropped after it: moving texts to sign each once would cost more
    signed = checkpointed(_signed(docs.where("node is not null").select("node", "text"), t, bands).dropDuplicates(["node"]))
    all_bands = signed.select(F.posexplode("bands").alias("no", "band"), "node")
    shared = checkpointed(all_bands.join(all_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    score = shared.groupBy("node").agg(F.sum(F.log("n")).alias("score"))
    hubs = shared.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("hub"))
    hub_pairs = shared.join(hubs, "band").where("node != hub.node").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    needed = shared.select(F.col("node").alias("_n")).distinct().join(first.withColumnRenamed("node", "_n"), "_n")
    wanted = docs.select("node", "_id", "text").join(needed, (F.col("node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    bags = checkpointed(_bags(wanted.select("node", "text")).dropDuplicates(["node"]))
    links = checkpointed(_verified(hub_pairs, bags, threshold))
    labels = connected_components(links)
    labelled = shared.join(labels, "node", "left").select("band", "no", "node", "n", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    open_bands = labelled.join(split, "band").join(signed.select("node", "sig", "bands"), "node")
    more = checkpointed(_other_links(open_bands, bags, threshold, t))
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = connected_components(links)
    degree = links.selectExpr("a as node").unionAll(links.selectExpr("b as node")).groupBy("node").agg(F.count(F.lit(1)).alias("_links"))
    classes = first.join(labels, "node", "left").select("node", "_first", F.coalesce("label", "node").alias("_label"))
    least_id = classes.groupBy("_label").agg(F.min("_first").alias("_class"))
    classes = classes.join(least_id, "_label").join(degree, "node", "left").select("node", "_class", F.coalesce("_links", F.lit(0)).cast("long").alias("_links"))
    joined = spread_join(docs.select(ROW, "_id", "node"), classes, "node", "_id", "left", ids)
    class_id = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id")
    return unpacked(joined, carry, class_id, "node", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
