"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight bytes. If two fingerprints differ in at most r bits, then at most r of their bytes
differ, so they share at least 8 - r bytes at their own positions. The index holds, for every choice of that many
positions (out of the first `positions`), the bytes found there: a pair meets in one of these lists exactly if its tally
of shared positional bytes reaches the guaranteed minimum, so the lists are the count filter. Whatever meets is verified
by counting bits.

Texts whose shingle sets are 0.8 alike differ in ten of 64 bits and share no guaranteed byte. For these the index holds
values of a second fingerprint: the minima of the shingles' hashes under VALUES orders, each of which two texts share
with the probability of their similarity. KEY values at their positions make a list, and the tally of shared positional
values decides which texts may be alike: what such pairs connect is a cluster, within which all are held against all by
their shingles, block by block, in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import digest_of, small, written
from shelfmark.llm.graph import components

#: Fingerprints of one list that a task compares at once; a longer list is dealt out as pairs of blocks.
BLOCK = 2048
#: Shingles that are hashed at once, so that memory doesn't grow with a text; those that meet all orders at once.
CHUNK, ORDERED = 1 << 16, 1 << 12
#: Minwise values of a text, and how many make a list's key: of pairs at 0.8 all but 6 in 10 million share a list.
VALUES, KEY = 60, 3
#: Shared values that a pair needs: pairs at 0.8 have fewer with a probability under 1 in a million.
TALLY = 32
#: Texts of a block whose shingles a task compares; shingles in so many of them are counted by a matrix product.
SETS, OFTEN = 1024, 64
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"order", i) | 1 for i in range(VALUES)], dtype=np.uint64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(words: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words, joined by spaces; of the whole sequence if it is shorter; in chunks."""
    if not words:
        return
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    begins = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[width - 1 :] or ends[-1:]
    h = xxhash.xxh64_intdigest
    for k in range(0, len(ends), CHUNK):
        yield np.array([h(joined[b:e], seed) for b, e in zip(begins[k : k + CHUNK], ends[k : k + CHUNK], strict=False)], dtype=np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, p], minlength=256) @ _BITS for p in range(8)])


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], width: int, seed: int) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for chunk in shingle_hashes(words, width, seed):
        n += len(chunk)
        ones += _ones(chunk)
    return _majority(ones, n)


def marks(words: list[bytes], width: int, seed: int) -> tuple[int, np.ndarray | None]:
    """The fingerprint, and the least of the shingles' hashes in each of VALUES orders; None without words."""
    ones, n, least = np.zeros(64, dtype=np.int64), 0, np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for chunk in shingle_hashes(words, width, seed):
        n += len(chunk)
        ones += _ones(chunk)
        for k in range(0, len(chunk), ORDERED):
            least = np.minimum(least, (chunk[k : k + ORDERED, None] * _MULTIPLIERS).min(axis=0))
    return _majority(ones, n), (least >> np.uint64(32)).astype(np.uint32).view(np.int32) if n else None


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprints(docs: DataFrame, width: int = 3, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): a signed long for each seed. Null and empty texts have fingerprint 0; ids may be null or repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[fingerprint(w, width, s) for s in seeds] for w in map(words_of, batch.column(1).to_pylist())]
            columns = np.array(rows, dtype=np.uint64).reshape(-1, len(seeds)).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], names=["id", *(f"fp{i}" for i in range(len(seeds)))])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ", ".join(f"fp{i} long" for i in range(len(seeds)))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {out}")


def _tree(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a minimum spanning forest over the fingerprints of one list whose bits differ in at most radius places.

    A forest of least distances joins what the full graph joins, at this radius and at any smaller one.
    """
    n = len(fp)
    if n == 2:
        ok = _shared(fp[:1], fp[1:], radius) <= radius
        return (np.flatnonzero(ok), np.flatnonzero(ok) + 1)
    best, parent, left = np.full(n, 255, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    us, vs, at = [], [], 0
    left[0] = False
    for _ in range(n - 1):
        d = _shared(fp[at : at + 1], fp, radius)
        nearer = (d < best) & left
        best[nearer], parent[nearer] = d[nearer], at
        at = int(np.argmin(np.where(left, best, 255)))
        if not left[at]:
            at = int(np.flatnonzero(left)[0])
        if best[at] <= radius:
            us.append(parent[at])
            vs.append(at)
        left[at] = False
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def _shared(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Differing bits of pairs, 255 for those that share fewer bytes than the radius guarantees."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return np.where(tally >= 8 - radius, np.bitwise_count(x), 255).astype(np.uint8)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and nodes of runs of whole lists; rows come sorted by (c, kv, b)."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        if not rows.shape[1]:
            continue
        if held:
            rows = np.concatenate([held.pop(), rows], axis=1)
        last = rows[:3, -1:]
        cut = int((rows[:3] == last).all(axis=0).argmax())  # where the last list begins; it may go on
        if cut:
            yield rows[:, :cut]
        held = [rows[:, cut:]]
    yield from held


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches):
            key, fp, node = rows[:3], np.ascontiguousarray(rows[3]).view(np.uint64), rows[4]
            begins = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            sizes = np.diff(np.append(begins, len(fp)))
            us, vs = [], []
            for n in range(2, 9):  # short lists: all of one size together
                at = begins[sizes == n]
                for i, j in combinations(range(n), 2):
                    near = _shared(fp[at + i], fp[at + j], radius) <= radius
                    us.append(node[at[near] + i])
                    vs.append(node[at[near] + j])
            for b, n in zip(begins[sizes > 8], sizes[sizes > 8], strict=True):
                u, v = _tree(fp[b : b + n], radius)
                us.append(node[b + u])
                vs.append(node[b + v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def near_links(nodes: DataFrame, radius: int = 3, positions: int = 7) -> DataFrame:
    """Links (u, v) that join all fingerprints differing in at most radius bits. nodes: (node long, fp long), distinct nodes.

    The lists hold min(8 - radius, positions - radius) bytes out of the first `positions`: with 7 and radius 3, four
    bytes, 35 lists a fingerprint, and a list of unrelated ones has one in 2**32 of them. A list of over BLOCK
    fingerprints is dealt out as pairs of blocks, each of which any task may compare; each task returns a spanning
    forest, so that the number of links stays linear.
    """
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(positions), positions - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = nodes.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("kv")) for i, m in enumerate(signed)))).alias("e")).select("e.c", "e.kv", "fp", "node")
    long = written(rows.groupBy("c", "kv").count().where(F.col("count") > BLOCK).select("c", "kv", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb")), "long")
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.least(own, o) * F.col("nb") + F.greatest(own, o))
    if long.isEmpty():
        dealt = rows.withColumn("b", F.lit(0))
    else:
        kept = rows.join(small(long), ["c", "kv"], "left")
        dealt = kept.withColumn("b", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    return (
        dealt.select("c", "kv", "b", "fp", "node").repartition("c", "kv", "b").sortWithinPartitions("c", "kv", "b", "fp")
        .mapInArrow(_links(radius), "u long, v long").where("u <> v").distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row: the smallest doc_id that links can reach.

    Nulls and texts without words have fingerprint 0 and are linked like any other; rows that share a fingerprint,
    exact copies among them, are one node of the graph, so that no copy is compared with another. Rows with a null
    doc_id take the component of their fingerprint. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, width, (seed,)).toDF("doc_id", "fp"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")).where("node is not null"), "nodes")
    joined = components(near_links(nodes, radius))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [marks(w, width, seed) for w in map(words_of, batch.column(1).to_pylist())]
        prints = np.array([f for f, _ in found], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array([m for _, m in found], pa.list_(pa.int32()))], names=["digest", "fp", "m"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its set of shingles."""
    for batch in batches:
        sets = [np.unique(np.concatenate([*shingle_hashes(w, width, seed), np.zeros(0, dtype=np.uint64)])).view(np.int64) for w in map(words_of, batch.column(batch.num_columns - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "s"])


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that follow one another in a list; rows (key, node) come sorted."""
    held = np.zeros((2, 0), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        same = rows[0, 1:] == rows[0, :-1]
        yield pa.RecordBatch.from_arrays([pa.array(rows[1, :-1][same]), pa.array(rows[1, 1:][same])], names=["u", "v"])
        held = rows[:, -1:]


def _neighbours(lists: DataFrame) -> DataFrame:
    """Links of neighbours in each list. Lists are cut where partitions end, so a long one is no task's own."""
    return lists.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_adjacent, "u long, v long")


def _shared_values(m: np.ndarray, few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of few and many share enough values."""
    return np.concatenate([(m[few[k : k + 64], None] == m[None, many]).sum(axis=2) >= TALLY for k in range(0, len(few), 64)])


def _alike(values: np.ndarray, sizes: np.ndarray, few: np.ndarray, many: np.ndarray, similarity: float) -> np.ndarray:
    """Which of few and many are as similar as asked for, by the sets that lie one after the other in values."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.zeros(n * n, dtype=np.float32)
    order = np.argsort(column, kind="stable")
    doc, times, begins = doc[order], times, np.cumsum(times) - times
    for t in np.unique(times[(times > 1) & (times < OFTEN)]):
        rows = doc[begins[times == t][:, None] + np.arange(t)]
        for k in range(0, len(rows), 1 + (1 << 22) // (t * t)):
            part = rows[k : k + 1 + (1 << 22) // (t * t)]
            shared += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n)
    shared = shared.reshape(n, n)
    often = np.flatnonzero(times >= OFTEN)
    for k in range(0, len(often), 2048):
        x = np.zeros((n, len(often[k : k + 2048])), dtype=np.float32)
        for j, c in enumerate(often[k : k + 2048]):
            x[doc[begins[c] : begins[c] + times[c]], j] = 1
        shared += x @ x.T
    shared = shared[np.ix_(few, many)].astype(np.float64)
    return shared >= similarity * (sizes[few][:, None] + sizes[many] - shared) - 1e-9


def _forest(near: np.ndarray, few: np.ndarray, many: np.ndarray, component: np.ndarray) -> tuple[list, list]:
    """As many of the near pairs as it takes to connect all components that they connect."""
    _, label = np.unique(component, return_inverse=True)
    us, vs = [], []
    for i, row in zip(few, near, strict=True):
        met = many[row]
        found, first = np.unique(label[met], return_index=True)
        new = found != label[i]
        if new.any():
            us += [i] * int(new.sum())
            vs += met[first[new]].tolist()
            label[np.isin(label, found[new])] = label[i]
    return us, vs


def _compare(similarity: float | None):
    """Links of rows (key, cell, major, component, node, values), which come by cell: a spanning forest of what is alike.

    Rows of the list's largest component (major) meet all others, and without these the others meet one another. By
    shared values, or with `similarity` by sets.
    """

    def of(table: pa.Table) -> pa.RecordBatch:
        key, cell, major, component, node = (table.column(i).to_numpy().astype(np.int64) for i in range(5))
        lists = table.column(5).combine_chunks()
        sizes, values = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy()
        ends = np.cumsum(sizes)
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        us, vs = [], []
        for b, n in zip(begins.tolist(), np.diff(np.append(begins, len(key))).tolist(), strict=True):
            if n < 2:
                continue
            few = np.flatnonzero(major[b : b + n] == 0)
            many = np.flatnonzero(major[b : b + n] == 1)
            many = many if len(many) else few
            part = values[ends[b] - sizes[b] : ends[b + n - 1]]
            near = _shared_values(part.reshape(n, VALUES), few, many) if similarity is None else _alike(part, sizes[b : b + n], few, many, similarity)
            u, v = _forest(near, few, many, component[b : b + n])
            us.append(node[b + np.array(u, dtype=np.int64)])
            vs.append(node[b + np.array(v, dtype=np.int64)])
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*us, none])), pa.array(np.concatenate([*vs, none]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(((key == key[-1]) & (cell == cell[-1])).argmax())  # where the last cell begins; it may go on
            other = held and (held[-1].column(0)[0], held[-1].column(1)[0]) != (batch.column(0)[0], batch.column(1)[0])
            if held and (cut or other) or cut:
                yield of(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """(key, cell, major, component, node) of rows (key, component, node), for keys of several components.

    A long list is dealt out: blocks of its largest component meet blocks of the others, and these one another.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    of = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("parts > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    rest = F.col("n") - F.col("most.n")
    cut = written(of.select("key", F.col("most.component").alias("largest"), blocks(F.col("most.n")).alias("nb"), blocks(rest).alias("ns"), (rest > 1).alias("others")), "open")
    major = F.col("component") == F.col("largest")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = F.transform(upto("ns"), lambda o: own("nb") * F.col("ns") + o)
    other = F.transform(upto("nb"), lambda o: o * F.col("ns") + own("ns"))
    among = F.transform(upto("ns"), lambda o: (F.col("nb") + F.least(own("ns"), o)) * F.col("ns") + F.greatest(own("ns"), o))
    cells = F.when(major, one).when(F.col("others"), F.concat(other, among)).otherwise(other)
    return rows.join(small(cut), "key").select("key", F.explode(cells).alias("cell"), major.cast("int").alias("major"), "component", "node")


def duplicate_rows(docs: DataFrame, width: int = 5, seed: int = 42, radius: int = 3, similarity: float = 0.8, nulls: bool = False) -> DataFrame:
    """(doc_id, digest) of all texts but one of each group of near-duplicates; digest is digest_of the text.

    Two texts are linked if the sets of their shingles of `width` words have a Jaccard similarity of at least
    `similarity`; groups are what links connect, and the text of the smallest doc_id stays. Candidates come from the
    byte-position index over fingerprints, which joins close copies, and from its lists of minwise values, which hold
    all others: neighbours in these lists, then components that still meet in one. Pairs that share enough values make
    clusters. Each cluster is dealt into blocks; tasks hold all texts of a block against one another by their shingles,
    then blocks of the largest group that came of it against blocks of all others.

    Equal texts are one node, with its smallest id, told apart by 128 bits. Texts without words are never in the result
    unless they are equal, nor are texts with a null id unless `nulls`: then they take part, and ids come before null.
    Null texts count as empty; rows may repeat. An empty table gives an empty result.
    """
    tagged = docs.where(F.lit(nulls) | F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    every = written(tagged.select("doc_id", "digest"), "rows")
    marked = tagged.select("digest", "text").mapInArrow(lambda b: _marked(b, width, seed), "digest binary, fp long, m array<int>").groupBy("digest").agg(F.first("fp").alias("fp"), F.first("m").alias("m"))
    copies = every.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(marked.join(copies, "digest").withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts, values, worded = nodes.select("node", "digest", "least", "copies"), nodes.select("node", "m"), nodes.where("m is not null")
    keys = F.array(*(F.xxhash64(F.lit(c), *(F.col("m")[i] for i in range(c, c + KEY))) for c in range(0, VALUES, KEY)))
    found = worded.select(F.explode(keys).alias("key"), "node")
    lists = written(found.join(small(written(found.groupBy("key").count().where("count > 1").select("key"), "keys")), "key"), "lists")

    shared = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    met = near_links(worded.select("node", "fp"), radius).unionByName(_neighbours(lists)).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    likely = written(met.join(values.toDF("u", "a"), "u").join(values.toDF("v", "b"), "v").where(shared >= TALLY).select("u", "v"), "likely")
    labelled = written(lists.join(small(components(likely)), "node", "left").select("key", F.coalesce("component", "node").alias("component"), "node"), "labelled")
    laid = _dealt(labelled, BLOCK).join(values, "node").select("key", "cell", "major", "component", "node", "m").repartition("key", "cell").sortWithinPartitions("key", "cell")
    more = written(laid.mapInArrow(_compare(None), "u long, v long"), "more")
    clusters = components(likely.unionByName(more))

    def verified(cells: DataFrame) -> DataFrame:
        """Links of rows (key, cell, major, component, node) that are as similar as asked for."""
        at = cells.join(texts.select("node", F.col("digest").alias("d"), "least"), "node")
        held = tagged.join(small(written(at, "cells")), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("least")))
        sets = held.select("key", "cell", "major", "component", "node", "text").mapInArrow(lambda b: _sets(b, width, seed), "key long, cell int, major int, component long, node long, s array<long>")
        return written(sets.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare(similarity), "u long, v long"), "alike")

    blocks = clusters.groupBy(F.col("component").alias("key")).agg(F.ceil(F.count("*") / SETS).cast("int").alias("blocks"))
    members = written(clusters.select(F.col("component").alias("key"), "node").join(small(written(blocks, "sizes")), "key"), "members")
    within = members.select("key", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("cell"), F.lit(0).alias("major"), F.col("node").alias("component"), "node")
    alike = verified(within)
    groups = components(alike)
    across = members.where("blocks > 1").join(small(groups), "node", "left").select("key", F.coalesce("component", "node").alias("component"), "node")
    if not across.isEmpty():
        groups = components(alike.unionByName(verified(_dealt(written(across, "across"), SETS))))
    member = written(texts.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "member")
    keep = member.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("best"))
    lost = F.col("d") != F.col("stays")
    gone = member.join(keep, "component").select(F.col("digest").alias("d"), "least", "copies", F.col("best.digest").alias("stays")).where(lost | (F.col("copies") > 1))
    gone = small(written(gone.select("d", "least", lost.alias("lost")), "gone"))
    return every.join(gone, every.digest == gone.d).where(F.col("lost") | ~F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "digest")
