"""Near-duplicate groups by a chosen-path set similarity join.

A text is the set of its word shingles. Texts with equal sets are folded into
one class first. Every class then walks down independent trees: at each level
of a tree it moves to the child named by the token of its set that is smallest
under that level's hash, so two sets of similarity J stay together for d
levels with probability J^d. A node is split until it is small and is then
compared exhaustively; what is still large at the last level is compared
exhaustively as well, so no node is capped. With 20 trees a pair at J = 0.8
that needs three levels is missed with probability 2e-6, two levels 1e-9.

Groups of thousands of near copies would make such comparisons quadratic, so
a first pass compares every member of a node with the node's most central
member only. The links found there join most of a group. What resembles such a
hub, linked or not, is its group; a group that is not yet one component is
compared in full, block against block, and only links that join components
leave the tasks. The trees then compare members of different components and
groups only; as components are the result, no link that matters is skipped.

Candidates are thinned by an estimate from the minwise values (bound chosen so
that a pair at the threshold fails it with probability under 1e-7) and then
confirmed on the whole shingle sets of the texts. The trees' nodes are compared
where their members meet, and members with a likely link meet there again with
their texts: rows name members, not pairs, and of the links found only those
that join components leave, so a large group of copies near or below the
threshold sends as many rows as it has members in its nodes' blocks.

Defined cases: NULL or wordless text has no shingles, links with nothing and
stands alone; rows with NULL id stand outside (component NULL, kept); rows
that repeat an id are judged on their own texts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fields, list_array, slices, stage_derived, text_bytes
from tessera.llm.components import components

TREES = 20
DEPTH = 4
STAR_TREES = 8
STAR_LEVEL = 2
LEAF = 24
#: Texts in a block of a group that is compared pair by pair.
BLOCK = 256
#: A piece of work in a node: two of its blocks, or one with itself.
PIECE = ["node", "i", "j"]
#: Bits of the id filter that keeps unwanted texts out of a shuffle: 2 MB,
#: whatever the corpus; a fuller filter lets more texts pass, never fewer.
FILTER_BITS = 1 << 24

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, width: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z in lower case; fewer words
    than ``width`` make one shingle of them all, no word makes none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = {} if known is None else known
    ids = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        code = known.get(word)
        if code is None:
            code = known[word] = xxhash.xxh3_64_intdigest(word)
        ids[i] = code
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - span + 1, span, dtype=np.uint64)
        for j in range(span):
            mixed = _scramble((mixed * _MIX) ^ ids[j : len(ids) - span + 1 + j])
    return np.unique(mixed)


def minwise(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Smallest hash of a set under each seed, 4,096 members at a time."""
    best = np.full(len(seeds), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 4096):
            part = shingles[start : start + 4096, None] ^ seeds[None, :]
            part *= np.uint64(0xD6E8FEB86659FD93)
            part ^= part >> np.uint64(32)
            part *= _MIX
            np.minimum(best, part.min(axis=0), out=best)
    return best


def tree_seeds(trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, size=trees * depth, dtype=np.uint64)


def sketches(docs: DataFrame, width: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``fp`` (set fingerprint), minwise values of each text."""
    seeds = tree_seeds(trees, depth)

    def work(batches):
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            ids, sizes, prints, values, bits = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width, known)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                low = minwise(found, seeds) if len(found) else np.empty(0, dtype=np.uint64)
                values.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
                bits.append((low >> np.uint64(20)).astype(np.uint8).tobytes())
                if len(known) > 200_000:  # a cache of word hashes only
                    known.clear()
            yield fields(
                ["doc_id", "n", "fp", "path", "sketch"],
                [ids, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), list_array(values, pa.int32()), pa.array(bits, pa.binary())],
            )

    columns = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return columns.mapInArrow(work, "doc_id long, n long, fp binary, path array<int>, sketch binary")


def set_classes(sketched: DataFrame) -> DataFrame:
    """One row per distinct shingle set; ``rep`` is its smallest document id, ``cls`` a number of its own.

    Copies meet before the shuffle (grouped minima), so a group of copies of
    any size sends one row per task. The number names the class in all later
    shuffles, in half the bytes of its fingerprint; it holds once the rows are
    written.
    """
    same = sketched.filter("n > 0 and doc_id is not null").groupBy("fp")
    rows = same.agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("path").alias("path"), F.min("sketch").alias("sketch")
    )
    return rows.withColumn("cls", F.monotonically_increasing_id())


def _node(level: int):
    """Key of the node a class reaches at a level of the row's tree."""
    return F.xxhash64("tree", F.lit(level), F.slice("path", 1, level))


def _by_tree(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per class and tree, with that tree's part of the path only."""
    rows = classes.select("*", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"))
    return rows.withColumn("path", F.slice("path", F.col("tree") * depth + 1, depth))


def star_candidates(classes: DataFrame, trees: int, depth: int, level: int, percent: int = 80) -> DataFrame:
    """Pairs of each node's most central member with its other members.

    Central is what shares large nodes in many trees: the text that copies
    were made from agrees with most of them. Counts and maxima are grouped,
    so a large node is one summary row.
    """
    rows = _by_tree(classes.select("cls", "n", "path"), trees, depth).select(_node(level).alias("node"), "cls", "n")
    sizes = rows.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stage_derived(rows.join(sizes, "node"))
    central = shared.groupBy("cls").agg(F.round(F.sum(F.log("members")), 6).alias("central"))
    ranked = shared.join(central, "cls").select("node", F.struct("central", "cls", "n").alias("who"))
    heads = ranked.groupBy("node").agg(F.max("who").alias("who"))
    heads = heads.select("node", F.col("who.cls").alias("a"), F.col("who.n").alias("n_a"))
    pairs = shared.select("node", "cls", "n").join(heads, "node").filter("cls <> a").filter(_sizes_fit("n", "n_a", percent))
    return pairs.select("a", F.col("cls").alias("b")).distinct()


def trees_for(percent: int) -> int:
    """Trees that miss a pair at the threshold after three levels as rarely as ``TREES`` do at 80 percent."""
    together = min(max(percent, 1) / 100, 0.8) ** 3
    return int(np.ceil(TREES * np.log1p(-(0.8**3)) / np.log1p(-together) - 1e-9))


def least_agreement(percent: int, values: int) -> int:
    """Equal minwise values, 5.6 standard deviations below what the threshold makes expect."""
    share = percent / 100
    return max(0, int(np.floor(share * values - 5.6 * np.sqrt(share * (1 - share) * values))))


def _sizes_fit(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def halo_groups(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class of a likely star pair with one ``hub``: the one with most members."""
    sizes = stars.groupBy("a").agg(F.count("*").alias("members"))
    sized = stars.join(sizes, "a").select("a", "b", "members")
    ends = sized.select(F.col("b").alias("cls"), F.struct("members", F.col("a").alias("hub")).alias("best"))
    ends = ends.union(sized.select("a", F.struct("members", "a")).distinct())
    hubs = ends.groupBy("cls").agg(F.max("best").alias("best")).select("cls", F.col("best.hub").alias("hub"))
    return hubs.join(classes.select("cls", "fp", "rep"), "cls")


def _local_links(texts: list[bytes], component: list[int], width: int, percent: int):
    """Index pairs of linked texts that join components of one pair of blocks.

    Intersections are products of incidence rows, a range of shingles at a
    time; of the links found, only those that join what is still apart leave.
    """
    sets = [shingle_set(t, width) for t in texts]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = uses[column] > 1  # a shingle of one text adds to no intersection
    owner, column = owner[kept], np.unique(column[kept], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = (column >= start) & (column < start + 4096)
        rows = np.zeros((len(sets), 4096), dtype=np.float32)
        rows[owner[part], column[part] - start] = 1
        common += rows @ rows.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(component[i]), find(component[j])
        if a != b:
            root[b] = a
            yield int(i), int(j)


def settled_links(docs: DataFrame, groups: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside every hub's group that is not yet one component, all pairs compared.

    A group is cut into blocks of about ``BLOCK`` texts and every pair of
    blocks is one bounded piece of work that compares whole sets and returns
    only links that join components, so neither pairs nor a large group are
    ever listed or gathered.
    """
    labelled = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.select("cls", "fp", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    still = labelled.groupBy("hub").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    still = still.filter("low < high").select("hub", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    open_rows = stage_derived(labelled.join(still, "hub"))
    texts = wanted_texts(docs, open_rows.select("cls", "fp", "rep"), width)
    block = F.pmod(F.hash("cls"), F.col("blocks")).alias("block")
    rows = open_rows.join(texts, "cls").select("hub", "rep", "component", "text", block, "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pieces = rows.select("hub", "rep", "component", "text", "block", other)
    pieces = pieces.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def work(table: pa.Table) -> pa.Table:
        reps, found = table["rep"].to_pylist(), []
        if len(reps) > 1:
            pairs = _local_links(table["text"].to_pylist(), table["component"].to_pylist(), width, percent)
            found = [(reps[i], reps[j]) for i, j in pairs]
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    pieces = pieces.select("hub", "i", "j", "rep", "component", "text")
    return pieces.groupBy("hub", "i", "j").applyInArrow(work, "u long, v long")


def path_members(
    classes: DataFrame, labels: DataFrame, groups: DataFrame, trees: int, depth: int, leaf: int
) -> DataFrame:
    """Members of the nodes to compare: those small enough, and the large ones of the last level.

    A node whose members all belong to one component, or to one hub's group
    (compared before), is settled. The others are done once they have at most
    ``leaf`` members or lie at the last level; larger ones move on by one
    level. Each level's open nodes are written once. Every class has a row in
    each tree here, so rows are narrow: numbers for names, and the tokens of
    the lower levels cut to what one long holds (equal tokens stay equal, and
    what then meets by chance is compared and dropped).
    """
    # labels meet names only; the paths, far wider, are shuffled once for both uses below (with no column that one of them lacks)
    labelled = classes.select("cls", "rep", "n").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.join(groups.select("cls", "hub"), "cls", "left")
    # a class without a hub is its own, so that the comparison below needs no NULL rule
    labelled = labelled.select("cls", "n", F.coalesce("hub", "cls").alias("hub"), F.coalesce("component", "rep").alias("component"))
    rows = _by_tree(classes.select("cls", "path").join(stage_derived(labelled), "cls"), trees, depth)
    token = lambda level: F.element_at("path", level).cast("long")
    bits = min(32, 63 // max(1, depth - 1))
    low = (1 << bits) - 1
    below = [F.shiftleft(token(level).bitwiseAND(low), bits * (level - 2)) for level in range(2, depth + 1)]
    first = F.shiftleft(F.col("tree").cast("long"), 32) + token(1).bitwiseAND((1 << 32) - 1)
    rows = rows.select("cls", "n", "component", "hub", first.alias("node"), reduce(lambda a, b: a + b, below, F.lit(0).cast("long")).alias("below"))
    ready = []
    for level in range(1, depth + 1):
        if level > 1:
            rows = rows.withColumn("node", F.xxhash64("node", F.shiftright("below", bits * (level - 2)).bitwiseAND(low)))
        open_nodes = rows.groupBy("node").agg(
            F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.min("hub").alias("first"), F.max("hub").alias("last"),
        )
        open_nodes = open_nodes.filter("members > 1 and low < high and first < last").select("node", "members")
        found = stage_derived(rows.join(open_nodes, "node"))
        small = found if level == depth else found.filter(F.col("members") <= leaf)
        ready.append(small.select("node", "members", "cls", "n", "component", "hub"))
        rows = found.filter(F.col("members") > leaf).drop("members")
    return reduce(DataFrame.union, ready)


def _piece_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where the pieces of sorted rows begin."""
    piece = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in PIECE])
    return np.concatenate([[0], np.nonzero((piece[:, 1:] != piece[:, :-1]).any(axis=0))[0] + 1])


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut where a piece ends; one batch and the piece it ends with are held."""
    rest = None
    for batch in batches:
        rows = pa.concat_batches([rest, batch]) if rest is not None else batch
        if not rows.num_rows:
            continue
        whole = int(_piece_starts(rows)[-1])
        rest = rows.slice(whole)
        if whole:
            yield rows.slice(0, whole)
    if rest is not None:
        yield rest


def _likely_in_pieces(rows: pa.RecordBatch, percent: int, least: int) -> np.ndarray:
    """Places of the rows with a likely link to settle in their piece; ``rows`` are sorted by piece.

    Row i meets row i + k of its piece for k = 1, 2, ...: one vector step per
    k serves all pieces, however small they are. A pair that shares several
    nodes is settled in the one of the smallest number.
    """
    piece = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in PIECE])
    own, size, component, hub = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("block", "n", "component", "hub"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
    nodes, counts = rows.column("nodes").flatten().to_numpy(zero_copy_only=False), pc.list_value_length(rows.column("nodes")).to_numpy(zero_copy_only=False)
    at = np.arange(counts.max(initial=1))
    # short lists repeat their first node, which adds to no intersection
    nodes = nodes[(np.cumsum(counts) - counts)[:, None] + np.where(at < counts[:, None], at, 0)]
    lone = piece[1] == piece[2]
    found, step = np.zeros(rows.num_rows, dtype=bool), 1
    start = np.arange(rows.num_rows)
    while len(start):
        start = start[start + step < rows.num_rows]
        start = start[(piece[:, start] == piece[:, start + step]).all(axis=0)]
        a, b = start, start + step
        ask = (component[a] != component[b]) & (hub[a] != hub[b]) & (lone[a] | (own[a] != own[b]))
        ask &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[ask], b[ask]
        good = (sketch[a] == sketch[b]).sum(axis=1) >= least
        a, b = a[good], b[good]
        here = np.ones(len(a), dtype=bool)
        for column in range(nodes.shape[1]):
            node = nodes[a, column]
            here &= (node >= piece[0, a]) | (nodes[b] != node[:, None]).all(axis=1)
        found[a[here]] = True
        found[b[here]] = True
        step += 1
    return np.nonzero(found)[0]


def likely_members(members: DataFrame, classes: DataFrame, trees: int, depth: int, percent: int) -> DataFrame:
    """Members of compared nodes with a likely link to another component and group there.

    A node is cut into blocks of about ``BLOCK`` members, and two blocks are
    one piece of work (``node``, ``i``, ``j``); most nodes are one piece.
    Pieces lie side by side in a sorted partition. A piece gives each of its
    rows at most once, however many likely links there are among them.
    """
    least = least_agreement(percent, trees * depth)
    names = [*PIECE, "block", "cls", "rep", "n", "component", "hub", "sketch", "nodes"]

    def work(batches):
        for rows in _whole_pieces(batches):
            found = _likely_in_pieces(rows, percent, least)
            if len(found):
                out = [*PIECE, "cls", "rep", "component"]
                yield fields(out, [rows.column(c).take(pa.array(found)) for c in out])

    # at most one node a tree
    nodes = members.groupBy("cls").agg(F.collect_list("node").alias("nodes"))
    rows = members.join(classes.select("cls", "rep", "sketch"), "cls").join(nodes, "cls")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("cls"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*names)
    # no key for a join or a grouping: a piece's rows must lie together and in order
    rows = rows.repartition(*PIECE).sortWithinPartitions(*PIECE, "cls")
    return rows.mapInArrow(work, "node long, i int, j int, cls long, rep long, component long")


def path_links(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the ``likely_members`` of each piece, whole sets compared (ids ``u``, ``v``).

    As in a hub's group, only links that join components leave a piece, so
    a large group of texts that resemble each other lists no pairs.
    """

    def work(batches):
        for rows in _whole_pieces(batches):
            starts = _piece_starts(rows)
            for start, end in zip(starts, [*starts[1:], rows.num_rows]):
                part = rows.slice(start, end - start)
                reps, component, texts = (part.column(c).to_pylist() for c in ("rep", "component", "text"))
                found = [(reps[i], reps[j]) for i, j in _local_links(texts, component, width, percent)]
                if found:
                    yield fields(["u", "v"], [pa.array(x, pa.int64()) for x in zip(*found)])

    members = stage_derived(members)  # read twice below
    ends = stage_derived(classes.select("cls", "fp", "rep").join(members.select("cls").distinct(), "cls"))
    texts = wanted_texts(docs, ends, width)
    rows = members.join(texts, "cls").select(*PIECE, "rep", "component", "text")
    rows = rows.repartition(*PIECE).sortWithinPartitions(*PIECE, "rep")
    return rows.mapInArrow(work, "u long, v long")


def likely(pairs: DataFrame, classes: DataFrame, trees: int, depth: int, percent: int = 80) -> DataFrame:
    """Pairs whose minwise values agree often enough for the threshold."""
    values = trees * depth
    least = least_agreement(percent, values)

    def work(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            a = np.frombuffer(b"".join(table["sketch_a"].to_pylist()), dtype=np.uint8).reshape(-1, values)
            b = np.frombuffer(b"".join(table["sketch_b"].to_pylist()), dtype=np.uint8).reshape(-1, values)
            good = pa.array((a == b).sum(axis=1) >= least)
            yield from table.select(["a", "rep_a", "b", "rep_b"]).filter(good).to_batches()

    side = classes.select("cls", "rep", "sketch")
    both = pairs.join(side.toDF("a", "rep_a", "sketch_a"), "a").join(side.toDF("b", "rep_b", "sketch_b"), "b")
    return both.mapInArrow(work, "a long, rep_a long, b long, rep_b long")


def wanted_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One text per wanted class (``cls``, ``fp``, ``rep``), beside its ``cls``.

    A filter of fixed size over the wanted ids thins the documents before the
    join on id; what passes by chance is dropped by the join.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = wanted.select(F.col("rep").alias("doc_id")).select(place.alias("bit")).distinct()
    # places count from 1 here: buckets of 32,768 bits, the lowest bit of a byte first
    packed = marks.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits")
    )
    marked = np.zeros(FILTER_BITS, dtype=bool)
    for row in packed.collect():  # at most FILTER_BITS / 8 bytes
        start = (row["bucket"] - 1) * 32768
        marked[start : start + 32768] = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")
    shared = spark.sparkContext.broadcast(np.packbits(marked))

    def work(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            for part in slices([batch.filter(pa.array(hit.astype(bool)))]):
                texts = part.column(1).to_pylist()
                prints = [xxhash.xxh3_128_digest(shingle_set(t, width).tobytes()) for t in texts]
                yield fields(["doc_id", "fp", "text"], [part.column(0), pa.array(prints, pa.binary()), part.column(1)])

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).filter("doc_id is not null")
    read = read.select("doc_id", "text", place.alias("bit"))
    texts = read.mapInArrow(work, "doc_id long, fp binary, text binary")
    # the id test is no join key, so that one shuffle on fp serves the grouping too
    texts = texts.join(wanted, "fp").filter("doc_id - rep = 0").groupBy("fp", "cls").agg(F.min("text").alias("text"))
    return texts.select("cls", "text")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the similarity (ids ``u``, ``v``)."""

    def work(batches):
        for batch in slices(batches, 64):
            good, seen = [], {}
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[a] = shingle_set(a, width)
                x, y = seen[a], shingle_set(b, width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield fields(["u", "v"], [batch.column(0), batch.column(1)]).filter(pa.array(good, pa.bool_()))

    pairs = stage_derived(pairs)  # read three times below
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    ends = stage_derived(classes.select("cls", "fp", "rep").join(ends, "cls"))
    texts = stage_derived(wanted_texts(docs, ends, width))
    full = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return full.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(work, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int | None = None,
    depth: int = DEPTH,
    leaf: int = LEAF,
) -> DataFrame:
    """Every row's set size, component and whether it represents its component.

    Links texts with 100 * intersection >= ``percent`` * union of their
    ``width``-word shingle sets. All filters follow ``percent``, and below 80
    so does the number of trees unless it is given. One output row per input
    row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked id),
    ``kept``. Runs jobs while it builds: sketches, classes, open nodes and
    links are written to the shared folder.
    """
    trees = trees_for(percent) if trees is None else trees
    sketched = stage_derived(sketches(docs, width, trees, depth))
    classes = stage_derived(set_classes(sketched))
    stars = star_candidates(classes, min(STAR_TREES, trees), depth, min(STAR_LEVEL, depth), percent)
    stars = stage_derived(likely(stars, classes, trees, depth, percent))
    links = stage_derived(confirmed(stars, classes, docs, width, percent))
    first = stage_derived(components(links))
    groups = stage_derived(halo_groups(stars, classes))
    links = stage_derived(links.union(settled_links(docs, groups, first, width, percent)))
    first = stage_derived(components(links))
    members = path_members(classes, first, groups, trees, depth, leaf)
    near = likely_members(members, classes, trees, depth, percent)
    links = links.union(path_links(near, classes, docs, width, percent))
    groups = stage_derived(components(links))
    by_set = classes.select("fp", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    by_set = by_set.select("fp", F.coalesce("component", "rep").alias("component_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    labelled = sketched.select("doc_id", "n", "fp").join(by_set, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return labelled.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_id_a_text(docs: DataFrame) -> DataFrame:
    """The documents with ``__uid``: their id, or where an id has several texts, one number for each text.

    Such numbers lie below -2**62, where no id is expected.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    several = stage_derived(seen.filter("low <> high").select("__id"))
    own = F.lit(-(1 << 62)) - F.xxhash64("doc_id", text).bitwiseAND((1 << 62) - 1)
    joined = docs.join(several, F.col("doc_id") == F.col("__id"), "left")
    return joined.withColumn("__uid", F.when(F.col("__id").isNull(), F.col("doc_id").cast("long")).otherwise(own)).drop("__id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that represent their group, with all their columns.

    Rows of one id are judged by their texts: equal texts leave one row,
    different texts stay unless they are near copies. Rows without an id stay.
    """
    own = _one_id_a_text(docs)
    judged = near_duplicates(own.select(F.col("__uid").alias("doc_id"), "text"), **options)
    kept = judged.filter("kept and doc_id is not null").select(F.col("doc_id").alias("__uid")).distinct()
    named = own.filter("doc_id is not null").join(kept, "__uid", "left_semi").dropDuplicates(["__uid"]).select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
