"""N-gram Jaccard join by set-relation skipping: classes, links and components of texts.

Sets are the distinct word shingles of whole texts (``shingles``), two sets link when their Jaccard similarity is
0.75 or more. Equal sets are one class; links are between classes. The result is exact up to collisions of
TOKEN_BITS-bit shingle hashes and 64-bit set hashes.

1. An inverted index of all shingles says how many sets hold each. It crosses the network packed: a task sorts
   the shingles of about BATCH_TOKENS at once and sends each shard of the hash range a compressed block (shingles as
   differences, sets as small numbers); the number of shards grows with the corpus. What only one set has is
   dropped there, the rest goes back to its batch, again packed. A set of which a quarter is its own can't link
   and ends here. The others keep their shared shingles, rare ones first: overlaps need no text any more.
   Shingles that are frequent within one batch (at most MOST_HOT are told to the tasks; any choice is right) skip
   the shards and come last in the order, so no shard holds the list of a shingle that a third of all sets have.
2. Two linked sets share a shingle in the first quarter of this order, so only that goes into the lists: rows
   (token, set, size, position). Each list first offers its least set as a hub: few pairs, linear in the lists, that
   link nearly all of a group of near copies. Lists that then still show different components put their sets, where
   position and sizes leave room for a link, into the family of the largest component among them.
3. A family is answered in cells of two blocks of sets of neighbouring sizes (all other blocks are skipped, as are two
   blocks of the component itself). A cell derives all its answers from one of its sets, the hub: with B what a set
   lacks of the hub and A what it has beyond it, the overlap of x and y is |hub| - |Bx| - |By| + |Bx & By| + |Ax & Ay|.
   Sizes of A and B alone decide most pairs; only a cell with open pairs looks at the small sets A and B. Cells
   return the least set that each set reaches, never pairs. Links are counted by the same cells inside each component.

Nothing is emitted for all pairs of a group, and no list, set of links or component is collected; the lineage is cut
by tables in the shared folder. Every plan is the same at every size.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component; fewer
than five words are one shingle; repeated rows and equal texts are one class; one doc_id on several texts keeps a row
for each, judged by its own set; a null doc_id keeps its size, links with nothing and has a null component; a
text's shingles are held at once while it is read, 8 bytes for each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut_lineage, small_batches, with_facts
from larder.llm.shingles import shingle_sets

#: Bits of a shingle's hash that are kept; shingles and sets that a task packs at once; shingles of a shard.
TOKEN_BITS, BATCH_TOKENS, BATCH_SETS, SHARD_TOKENS = 52, 2_000_000, 60_000, 1_000_000
#: Sets of a batch that make a shingle hot, and hot shingles that are broadcast at most (the most frequent, 16 MB).
HOT, MOST_HOT = 16, 1_000_000
#: Entries of a list that stay together in a join.
LIST_ROWS = 1000
#: Sets of a block whose links are counted with another block at once, and columns of the matrices that do it.
BLOCK_SETS, COLUMNS = 256, 8192


def needed(n: Column, m: Column, overlap: Column) -> Column:
    """Whether an overlap makes sets of sizes n and m link: 100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (n + m)


class Batch:
    """Some rows of a task: ids, sets and set hashes, and the distinct sets among them."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        import xxhash

        self.ids, self.sets = ids, sets
        self.keys = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
        first: dict[int, int] = {}
        for i, k in enumerate(self.keys):
            if k is not None and ids[i] is not None:
                first.setdefault(k, i)
        self.own_keys = np.array(list(first), np.int64)
        self.own = [sets[i] for i in first.values()]
        self.sizes = np.array([len(s) for s in self.own], np.int64)
        self.tokens = np.concatenate(self.own) if self.own else np.zeros(0, np.uint64)
        self.set_of = np.repeat(np.arange(len(self.own)), self.sizes)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Batches of about BATCH_TOKENS shingles; a larger text is alone in one."""
    ids, sets, held = [], [], 0
    for b in rows:
        for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
            s = s >> np.uint64(64 - TOKEN_BITS)
            if (s[1:] == s[:-1]).any():
                s = np.unique(s)
            if sets and (held + len(s) > BATCH_TOKENS or len(sets) >= BATCH_SETS):
                yield Batch(ids, sets)
                ids, sets, held = [], [], 0
            ids.append(doc_id)
            sets.append(s)
            held += len(s)
    if sets:
        yield Batch(ids, sets)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and key (set hash, null if empty) of every row; a batch's first row has its hot shingles and their counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows):
            tokens, counts = np.unique(b.tokens, return_counts=True)
            hot = counts >= HOT
            rest = [None] * (len(b.ids) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, pa.int64()), pa.array([len(s) for s in b.sets], pa.int64()), pa.array(b.keys, pa.int64()), pa.array([tokens[hot].view(np.int64), *rest], pa.list_(pa.int64())), pa.array([counts[hot], *rest], pa.list_(pa.int64()))],
                ["doc_id", "n", "key", "hot", "often"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key bigint, hot array<bigint>, often array<bigint>")


def hot_tokens(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the hot shingles, at most MOST_HOT, in order, with the sum of their counts where they are hot."""
    pairs = table.filter("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "often")).alias("h"))
    rows = pairs.groupBy(F.col("h.hot").alias("token")).agg(F.sum("h.often").alias("often")).orderBy(F.desc("often"), "token").limit(MOST_HOT).toPandas()
    rows = rows.sort_values("token")
    return rows["token"].to_numpy(np.int64).view(np.uint64), rows["often"].to_numpy(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as byte planes, compressed; what is small or alike costs little."""
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


_POSTED = "shard int, batch bigint, head binary, data binary"


def postings(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], shard_bits: int) -> DataFrame:
    """Blocks of (token, set) for each shard and batch; one row of a batch has its sets' keys and sizes and its hot postings."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # MOST_HOT shingles at most

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot, often = shared.value
        for number, b in enumerate(_batches(rows)):
            batch = (TaskContext.get().partitionId() << 32) + number
            at = np.minimum(np.searchsorted(hot, b.tokens), max(len(hot) - 1, 0))
            is_hot = hot[at] == b.tokens if len(hot) else np.zeros(len(b.tokens), bool)
            head = pa.array([_pack(b.own_keys, b.sizes)], pa.binary())
            counts = np.minimum(often[at[is_hot]], (1 << 32) - 1) if len(hot) else np.zeros(0)
            rows_ = [(number % (1 << shard_bits), _pack(b.set_of[is_hot].astype(np.uint16), b.tokens[is_hot], counts.astype(np.uint32)))]
            yield pa.RecordBatch.from_arrays([pa.array([rows_[0][0]], pa.int32()), pa.array([batch]), head, pa.array([rows_[0][1]], pa.binary())], ["shard", "batch", "head", "data"])
            tokens, set_of = b.tokens[~is_hot], b.set_of[~is_hot].astype(np.uint16)
            order = np.argsort(tokens, kind="stable")
            tokens, set_of = tokens[order], set_of[order]
            ends = np.searchsorted(tokens, np.arange(1, (1 << shard_bits) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS - shard_bits))
            starts = np.concatenate(([0], ends[:-1]))
            used = np.flatnonzero(ends > starts)
            for some in np.array_split(used, -(-len(used) // 256) or 1):
                blocks = [_pack(np.diff(tokens[starts[k] : ends[k]], prepend=np.uint64(0)), set_of[starts[k] : ends[k]]) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), batch)), pa.nulls(len(some), pa.binary()), pa.array(blocks, pa.binary())], ["shard", "batch", "head", "data"])

    return docs.mapInArrow(run, _POSTED)


def shared_postings(posted: DataFrame) -> DataFrame:
    """The blocks of each batch again: (set, token, count of sets) where more than one set has the token. Batches count apart."""

    def run(rows: pa.Table) -> pa.Table:
        batches, heads, blocks = (rows.column(c).to_pylist() for c in ("batch", "head", "data"))
        out = [(b, h, d) for b, h, d in zip(batches, heads, blocks, strict=True) if h is not None]
        batches = [b for b, h in zip(batches, heads, strict=True) if h is None]
        parts = [_unpack(d, np.uint64, np.uint16) for d, h in zip(blocks, heads, strict=True) if h is None]
        if parts:
            sizes = [len(t) for t, _ in parts]
            tokens = np.concatenate([np.cumsum(t, dtype=np.uint64) for t, _ in parts])
            set_of, part = np.concatenate([s for _, s in parts]), np.repeat(np.arange(len(parts)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            heads_at = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] ^ np.uint64(1)))
            runs = np.diff(np.append(heads_at, len(tokens)))
            count = np.repeat(runs, runs)
            keep = count > 1
            tokens, order, count = tokens[keep], order[keep], count[keep]
            by_set = np.lexsort((set_of[order], part[order]))
            tokens, order, count = tokens[by_set], order[by_set], np.minimum(count[by_set], (1 << 32) - 1).astype(np.uint32)
            ends = np.searchsorted(part[order], np.arange(len(parts)), side="right")
            for k, (a, z) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
                if z > a:
                    out.append((batches[k], None, _pack(set_of[order[a:z]], tokens[a:z], count[a:z])))
        return pa.table({"batch": pa.array([r[0] for r in out], pa.int64()), "head": pa.array([r[1] for r in out], pa.binary()), "data": pa.array([r[2] for r in out], pa.binary())})

    return posted.groupBy("shard").applyInArrow(run, "batch bigint, head binary, data binary")


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - -(-3 * n // 4) + 1


def live_sets(shared: DataFrame) -> DataFrame:
    """(key, n, own, tokens, often): sets that share three quarters of their shingles; the shared ones, rare ones first, with the counts of those in the prefix."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [_unpack(d, np.uint16, np.uint64, np.uint32) for d in rows.column("data").to_pylist()]
        keys, sizes = _unpack(next(h for h in rows.column("head").to_pylist() if h is not None), np.int64, np.int64)
        set_of, tokens, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
        held = np.bincount(set_of, minlength=len(keys))
        live = 4 * held >= 3 * sizes
        some = live[set_of]
        set_of, tokens, often = set_of[some], tokens[some], often[some]
        order = np.lexsort((tokens, often, set_of))
        set_of, tokens, often = set_of[order], tokens[order], often[order]
        keys, sizes, held = keys[live], sizes[live], held[live]
        at = np.concatenate(([0], np.cumsum(held)))
        first = np.repeat(_prefix(sizes) - (sizes - held), held) > np.arange(len(tokens)) - np.repeat(at[:-1], held)
        cut = np.concatenate(([0], np.cumsum(first)))[at]
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64))), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(often[first].astype(np.int64)))]
        return pa.table({"key": pa.array(keys), "n": pa.array(sizes.astype(np.int32)), "own": pa.array((sizes - held).astype(np.int32)), "tokens": lists[0], "often": lists[1]})

    found = shared.groupBy("batch").applyInArrow(run, "key bigint, n int, own int, tokens array<bigint>, often array<bigint>")
    return found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "own", "tokens", "often")))


def lists(sets: DataFrame) -> DataFrame:
    """(token, salt, salts, cls, n, pos): the prefixes of the sets; a long list has its entries under several salts."""
    rows = sets.select(F.col("key").alias("cls"), "n", "own", "tokens", F.posexplode("often").alias("at", "times"))
    salts = (1 + F.floor(F.col("times") / LIST_ROWS)).cast("int")
    rows = rows.select(F.get("tokens", F.col("at")).alias("token"), salts.alias("salts"), "cls", "n", (F.col("own") + F.col("at")).alias("pos"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))


def _salted(per_list: DataFrame) -> DataFrame:
    """A row per salt of tables with one row per list."""
    return per_list.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable over edges (a, b), for every id in an edge; alternating large and small stars."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut_lineage(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            stars = edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id")
            return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())


def open_lists(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that still show sets of different components, with their component and its size."""
    known = labels.join(labels.groupBy("comp").agg(F.count("*").alias("size")), "comp").select(F.col("id").alias("cls"), "comp", "size")
    rows = index.join(known, "cls", "left").withColumns({"comp": F.coalesce("comp", "cls"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    open_ = rows.groupBy("token", "salts").agg(F.count("*").alias("sets"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("sets > 2 AND lo <> hi")  # a list of two sets has been answered by its hub
    return rows.join(_salted(open_.select("token", "salts")), ["token", "salt"], "left_semi")


def hub_pairs(index: DataFrame) -> DataFrame:
    """(x, y): sets with their list's least set, its hub, where sizes and positions allow a link."""
    hubs = index.groupBy("token", "salts").agg(F.min(F.struct("cls", "n", "pos")).alias("hub"))
    left = F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos"))
    fits = (F.col("cls") != F.col("hub.cls")) & (4 * F.least("n", "hub.n") >= 3 * F.greatest("n", "hub.n")) & (7 * left >= 3 * (F.col("n") + F.col("hub.n")))
    rows = index.join(_salted(hubs), ["token", "salt"]).filter(fits)
    return rows.select(F.least("cls", "hub.cls").alias("x"), F.greatest("cls", "hub.cls").alias("y")).distinct()


def _size_block(n: Column) -> Column:
    """Sizes that can link lie in one block or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3))).cast("int")


def families(rows: DataFrame) -> DataFrame:
    """(fam, cls, n, core): the sets of each open list, under the largest component in it; core: of that component itself.

    A set stays only where an entry's position allows a link with some set of the list's sizes.
    """
    lists_ = rows.groupBy("token", "salts").agg(F.min(F.struct((-F.col("size")).alias("rank"), "comp")).alias("top"), F.min("n").alias("least"), F.max(F.when(7 * (F.col("n") - F.col("pos")) >= 6 * F.col("n"), F.col("n"))).alias("most"))
    lists_ = _salted(lists_.select("token", "salts", F.col("top.comp").alias("fam"), "least", "most"))
    left = F.col("n") - F.col("pos")
    # the partner that the position leaves room for: overlaps of at most ``left`` need 7 * left >= 3 * (n + m); in a pair the smaller set needs 7 * left >= 6 * n
    fits = (7 * left >= 3 * (F.col("n") + F.greatest("least", F.ceil(0.75 * F.col("n"))))) & (4 * F.col("most") >= 3 * F.col("n"))
    return rows.join(lists_, ["token", "salt"]).filter(fits).select("fam", "cls", "n", (F.col("comp") == F.col("fam")).alias("core")).distinct()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) of those pairs whose sets, compared in full, link."""
    side = lambda k: sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"s{k}"))
    overlap = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(side("x"), "x").join(side("y"), "y").filter(needed(F.col("nx"), F.col("ny"), overlap)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def cell_links(own: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], same: bool) -> tuple[np.ndarray, int]:
    """Which sets of a cell link with which of the other block (same: of their own), and how many pairs sizes alone left open."""
    hub = sets[int(np.argmax(sizes))]
    beyond = [np.setdiff1d(s, hub, assume_unique=True) for s in sets]
    lacking = [np.setdiff1d(hub, s, assume_unique=True) for s in sets]
    a, b = (np.array([len(x) for x in part], np.int64) for part in (beyond, lacking))
    asked = np.ones((len(sets), len(sets)), bool) if same else own[:, None] != own[None, :]
    np.fill_diagonal(asked, False)
    bar = 3 * (sizes[:, None] + sizes[None, :])
    low = len(hub) - b[:, None] - b[None, :]
    links = 7 * low >= bar
    open_ = asked & ~links & (7 * (low + np.minimum(a[:, None], a[None, :]) + np.minimum(b[:, None], b[None, :])) >= bar)
    if open_.any():
        of = np.repeat(np.arange(len(sets)), a + b)
        words = np.unique(np.concatenate([x for pair in zip(beyond, lacking, strict=True) for x in pair]), return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(words.max()) + 1, COLUMNS):
            some = (words >= at) & (words < at + COLUMNS)
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[of[some], words[some] - at] = 1
            both += m @ m.T
        links = np.where(open_, 7 * (low + both.astype(np.int64)) >= bar, links)
    return links & asked, int(open_.sum()) // 2


def cells(members: DataFrame) -> DataFrame:
    """The rows (fam, key, n, tokens, core) of each family in cells of two blocks whose sizes can link; not for two blocks of the core."""
    rows = members.withColumn("band", _size_block(F.col("n")))
    blocks = cut_lineage(rows.groupBy("fam", "core", "band").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks")))
    partners = blocks.select("fam", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"), F.col("core").alias("_core"), F.col("band").alias("_band"), F.col("blocks").alias("_blocks"))
    block = F.struct("core", "band", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("no"))
    other = F.struct(F.col("_core").alias("core"), F.col("_band").alias("band"), F.col("_no").alias("no"))
    rows = rows.join(blocks, ["fam", "core", "band"]).join(partners, ["fam", "band"]).filter("NOT (core AND _core)")
    rows = rows.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("fam", F.least(block, other).alias("one"), F.greatest(block, other).alias("two"), (block <= other).alias("first"), (block == other).alias("same"), "key", "n", "tokens")


def _answers(cell: pa.Table) -> np.ndarray:
    own, sizes = cell.column("first").to_numpy().astype(bool), cell.column("n").to_numpy().astype(np.int64)
    return cell_links(own, sizes, [np.sort(np.asarray(t, np.int64)) for t in cell.column("tokens").to_numpy()], cell.column("same")[0].as_py())[0]


def cell_edges(members: DataFrame) -> DataFrame:
    """(a, b): every set with the least set that it reaches by links of one cell."""

    def run(cell: pa.Table) -> pa.Table:
        links, keys = _answers(cell), cell.column("key").to_numpy()
        np.fill_diagonal(links, True)
        labels, before = keys, None
        while before is None or (labels != before).any():
            before, labels = labels, np.where(links, labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        far = labels != keys
        return pa.table({"a": pa.array(keys[far]), "b": pa.array(labels[far])})

    return cells(members).groupBy("fam", "one", "two").applyInArrow(run, "a bigint, b bigint")


def link_counts(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, n_links): the classes that each class of a component of at least two links with."""
    members = sets.join(labels.select(F.col("id").alias("key"), F.col("comp").alias("fam")), "key").withColumn("core", F.lit(False))

    def run(cell: pa.Table) -> pa.Table:
        return pa.table({"cls": cell.column("key"), "links": pa.array(_answers(cell).sum(axis=1).astype(np.int64))})

    return cells(members).groupBy("fam", "one", "two").applyInArrow(run, "cls bigint, links bigint").groupBy("cls").agg(F.sum("links").alias("n_links"))


def link_labels(sets: DataFrame) -> DataFrame:
    """(id, comp) of all sets that link, by set hash; sets are those of ``live_sets``."""
    index = cut_lineage(lists(sets))
    labels = cut_lineage(components(linked(hub_pairs(index), sets)))
    rest = cut_lineage(families(open_lists(index, labels)))
    if rest.isEmpty():
        return labels
    new = cell_edges(rest.withColumnRenamed("cls", "key").join(sets.select("key", "tokens"), "key"))
    return cut_lineage(components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(new)))


def indexed_sets(lean: DataFrame, table: DataFrame) -> DataFrame:
    """``live_sets`` of documents (doc_id, text), of which table is the ``set_table``."""
    total = table.agg(F.sum("n")).first()[0] or 0
    shard_bits = max(0, (int(total) // SHARD_TOKENS).bit_length())
    return live_sets(shared_postings(postings(lean, hot_tokens(table), shard_bits)))


def link_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with an equal set) and n_links (other classes its class links with) of every document."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        table = cut_lineage(set_table(lean))
        sets = cut_lineage(indexed_sets(lean, table))
    classes = table.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("cls"), F.count("*").alias("copies"))
    labels = link_labels(sets)
    named = labels.select(F.col("id").alias("key"), "comp").join(classes, "key")
    least = named.groupBy("comp").agg(F.min("cls").alias("least"))
    named = named.join(least, "comp").select("key", "least")
    if count_links:
        named = named.join(link_counts(sets, labels).withColumnRenamed("cls", "key"), "key", "left")
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    facts = cut_lineage(classes.join(named, "key", "left"))
    rows = table.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = with_facts(rows, facts, "key", rows.count(), "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "cls", "doc_id").alias("component_id"), F.coalesce("cls", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out if count_links else out.drop("n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those of which another document of their component has a smaller doc_id; a null doc_id stays."""
    gone = link_components(docs, count_links=False).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
