"""Exact Jaccard join on word shingles by a token-group matrix.

Equal shingle sets become one. Similar documents are partitioned into groups: those that share least shingles, under several
of some hashes, go with the one among them that shares most, whether they link to it or not; a large group is dealt into
parts of bounded size. A group is stored as the union of its members' leading shingles (rarest first, as many as a
partner cannot miss all of). A document meets those groups whose union holds one of its own leading shingles, if the sizes
of both without the leading shingles of no other group suffice for a link, and unless all members are connected with it
already; from the number of shared ones follows a bound on the overlap with any member, and only groups within the bound
are opened. An opened group and a bounded number of the documents that opened it meet in one task, which counts all their
overlaps from the shingles themselves and returns links that connect something new; so no pair of documents is a row.

Null and blank texts have no shingle, link with nothing and are their own component. Fewer words than a shingle make
one shingle of the whole sequence. Rows that repeat an id are versions of one document, and so connected. Rows without an id
have no component (null) and connect nothing. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import hashed_in
from ..session import cut_lineage, store_parts
from .sides import file_of, meeting, meeting_by_file, small
from .words import columns, emit, mix, shingles, signed

# The shingles that count as common are at most this many, so that they can be sent to every task.
COMMON = 1 << 18
# Hashes under which least shingles are compared, and how many must agree with a leader's to be taken for similar.
HASHES = 8
AGREE = 3
# So many times a set's leading shingles are kept and counted to find the common ones, since others move up in their place.
COUNTED = 2
# A shingle is not common below so many documents.
RARE = 64
# Documents and shingles of a part of a group, and of those that meet it in one task.
PART, PART_SHINGLES = 2048, 1 << 22
# Shingles that are compared in one task, and that a task holds before it deals them out.
RANGE, HELD = 1 << 18, 1 << 20
# Bytes of sets or packed shingles that a task hands on at once; both sides of the hand-over hold them.
BATCH = 1 << 22


def least_overlap(m, n, percent):
    """The smallest intersection of sets of m and n that links them."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_size(m: int, percent: int) -> int:
    """So many leading shingles that a linked set of any size shares at least one."""
    return m + (percent * m) // -100 + 1


def counted_as(tokens: np.ndarray, n_ranges: int) -> np.ndarray:
    """What shingles are counted by: their range and 32 bits of a hash. Rare shingles of a common one's code count as common
    with it, which only moves them back in the order."""
    h = mix(tokens + np.uint64(1))
    return (h % np.uint64(n_ranges)) << np.uint64(32) | h >> np.uint64(32)


def order_key(tokens: np.ndarray, codes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted shingles with the common ones last, those by their rank and value, and the number of the others. ``codes`` are
    what the shingles are counted by, ``common`` is sorted, ``ranks`` goes with it."""
    if not len(common):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
    is_common = common[at] == codes
    rare = tokens[~is_common]
    return np.concatenate([rare, tokens[is_common][np.argsort(ranks[at[is_common]], kind="stable")]]), len(rare)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, m, a, b, keys, lead): size and 128-bit hash of each document's set, its least values under several hashes,
    and its first shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int64())), ("lead", pa.binary())])
    seeds = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, HASHES + 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in columns(batches):
                t = shingles(text, width)
                raw = xxhash.xxh3_128_intdigest(t.tobytes())
                a, b = np.array([raw >> 64, raw & (1 << 64) - 1], np.uint64).view(np.int64)
                keys = [int(signed(mix(t ^ seed).min(keepdims=True))[0]) for seed in seeds] if len(t) else None
                yield doc_id, len(t), int(a), int(b), keys, t[: COUNTED * prefix_size(len(t), percent)].tobytes()

        yield from emit(rows(), schema, 2000, BATCH)

    return docs.mapInArrow(run, "doc_id long, m long, a long, b long, keys array<long>, lead binary")


def _edges(at: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values start and end."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() if len(at) else []
    return list(zip(first, [*first[1:], len(at)]))


def planes(x: np.ndarray) -> bytes:
    """Differences of neighbours, all first bytes before all second ones and so on, so that small ones compress well."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(packed: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(width, -1).T.copy().view(dtype)[:, 0], dtype=dtype)


def _by_range(n_ranges: int, held: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Shingles of (document, group, shingles) by the range of the shingle, packed with their document and group, which
    often is the document. Leading shingles being least values, ranges go by another hash."""
    if not held:
        return
    held = sorted(held, key=lambda r: r[0])
    tokens = np.concatenate([t for _, _, t in held])
    of = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for _, _, t in held])
    doc = np.array([d for d, _, _ in held], np.int64).view(np.uint64)
    off = doc - np.array([g for _, g, _ in held], np.int64).view(np.uint64)
    at = (mix(tokens + np.uint64(1)) % np.uint64(n_ranges)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    at, tokens, of = at[order], tokens[order], of[order]
    for first, last in _edges(at):
        here = of[first:last]
        yield int(at[first]), tokens[first:last].tobytes() + planes(doc[here]) + planes(off[here])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, documents and groups of the packed rows."""
    parts = []
    for packed in table.column("packed").to_pylist():
        n = len(packed) // 24
        doc = from_planes(packed[8 * n: 16 * n], np.uint64)
        parts.append((np.frombuffer(packed, np.uint64, n), doc, doc - from_planes(packed[16 * n:], np.uint64)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _common(leads: DataFrame, total: int):
    """What common shingles are counted by, sorted, the place of each by frequency, and the number of ranges, sent to the
    tasks. By its threshold their number never exceeds COMMON. Each task counts its own shingles and hands the counts on by
    range, packed."""
    n_ranges, least = max(1, total // RANGE), max(RARE, -(-total // COMMON))
    schema = pa.schema([("range", pa.int64()), ("packed", pa.binary())])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> Iterator[tuple]:
            codes, counts = np.unique(counted_as(np.concatenate(held), n_ranges), return_counts=True)
            low, counts = codes.astype(np.uint32), counts.astype(np.uint32)
            for first, last in _edges(codes >> np.uint64(32)):
                yield int(codes[first] >> np.uint64(32)), planes(low[first:last]) + planes(counts[first:last])

        def rows():
            held: list[np.ndarray] = [np.zeros(0, np.uint64)]
            have = 0
            for (lead,) in columns(batches):
                held.append(np.frombuffer(lead, np.uint64))
                have += len(held[-1])
                if have > HELD:
                    yield from out(held)
                    held, have = held[:1], 0
            yield from out(held)

        yield from emit(rows(), schema, 64, BATCH)

    def merged(table: pa.Table) -> pa.Table:
        halves = [(p[: len(p) // 2], p[len(p) // 2:]) for p in table.column("packed").to_pylist()]
        low = np.concatenate([from_planes(p, np.uint32) for p, _ in halves])
        counts = np.concatenate([from_planes(p, np.uint32) for _, p in halves]).astype(np.int64)
        order = np.argsort(low)
        low, counts = low[order], counts[order]
        first = np.array([f for f, _ in _edges(low)])
        sums = np.add.reduceat(counts, first)
        often = sums > least
        codes = low[first][often].astype(np.int64) | (table.column("range")[0].as_py() << 32)
        return pa.table({"code": pa.array(codes), "n": pa.array(sums[often])})

    rows = leads.select("lead").mapInArrow(packed, "range long, packed binary").groupBy("range").applyInArrow(merged, "code long, n long").toArrow()
    held, counts = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(held)
    ranks = np.empty(len(held), np.int64)
    ranks[np.lexsort((held[order], counts[order]))] = np.arange(len(held))
    return leads.sparkSession.sparkContext.broadcast((held[order], ranks, n_ranges))


def _matrix_rows(spark: SparkSession, leads: Iterable[DataFrame], docs: DataFrame, common, total: int, width: int, percent: int) -> DataFrame:
    """(token, doc_id, g): the leading shingles that documents of at least two groups lead with. ``leads``, in parts, have
    doc_id, g, m and lead.

    Shingles are compared by range. The common ones, of which a range might hold any number, are rows at once. Where too
    many of a document's kept shingles are common, its text is read again.
    """
    n_ranges = max(1, total // RANGE)
    schema = pa.schema([("range", pa.int32()), ("token", pa.int64()), ("doc_id", pa.int64()), ("g", pa.int64()), ("packed", pa.binary())])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks, counted_ranges = common.value

        def rows():
            held: list[tuple[int, int, np.ndarray]] = []
            have = 0
            out = lambda: ((k, None, None, None, p) for k, p in _by_range(n_ranges, held))
            for doc_id, g, m, lead, text in columns(batches):
                t = np.frombuffer(lead, np.uint64) if text is None else shingles(text, width)
                m = m if text is None else len(t)
                size = prefix_size(m, percent)
                whole = len(t) == m
                t, rare = order_key(t, counted_as(t, counted_ranges), often, ranks)
                if rare < size and not whole:
                    yield None, None, doc_id, g, None
                    continue
                yield from ((None, token, doc_id, g, None) for token in signed(t[rare:size]).tolist())
                # A copy, since a slice would keep all kept shingles in memory.
                t = t[: min(rare, size)].copy()
                held.append((doc_id, g, t))
                have += len(t)
                if have > HELD:
                    yield from out()
                    held, have = [], 0
            yield from out()

        yield from emit(rows(), schema, 4096, BATCH)

    def shared(table: pa.Table) -> pa.Table:
        token, doc, g = _unpacked(table)
        order = np.lexsort((g, token))
        token, doc, g = token[order], doc[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        last = np.concatenate([first[1:], [len(token)]])
        many = np.repeat(g[first] != g[last - 1], last - first)
        return pa.table({"token": pa.array(signed(token[many])), "doc_id": pa.array(signed(doc[many])), "g": pa.array(signed(g[many]))})

    made = "range int, token long, doc_id long, g long, packed binary"
    read = (part.select("doc_id", "g", "m", "lead", F.lit(None).cast("binary").alias("text")).mapInArrow(dealt, made) for part in leads)
    kept = store_parts(spark, read, "leading-shingles")
    unread = cut_lineage(spark, kept.filter("range IS NULL AND token IS NULL").select("doc_id", "g").distinct(), "texts-to-read-again")
    texts = meeting(docs, unread, "doc_id").select("doc_id", "g", F.lit(0).cast("long").alias("m"), F.lit(b"").alias("lead"), "text").filter("text IS NOT NULL")
    kept = kept.filter("range IS NOT NULL OR token IS NOT NULL").unionByName(texts.mapInArrow(dealt, made))
    compared = kept.filter("range IS NOT NULL").select("range", "packed").groupBy("range").applyInArrow(shared, "token long, doc_id long, g long")
    return compared.unionByName(kept.filter("token IS NOT NULL").select("token", "doc_id", "g"))


def cell_links(members: list[tuple], askers: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of roots that links between members and askers, both (doc_id, root, shingles), connect; no more than connect
    anything new."""
    of = np.repeat(np.arange(len(members)), [len(t) for _, _, t in members])
    tokens = np.concatenate([t for _, _, t in members])
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    sizes = np.array([len(t) for _, _, t in members])
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x] = up.get(up[x], up[x])
        return x

    for doc_id, root, own in askers:
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
        found = high > low
        low, n = low[found], (high - low)[found]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else low
        both = np.bincount(of[entry], minlength=len(members))
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (len(own) + sizes - both))).tolist():
            a, b = find(root), find(members[j][1])
            if a != b:
                up[max(a, b)] = min(a, b)
                yield root, members[j][1]


def _linked(docs: DataFrame, asks: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(x, y): roots of linked documents. ``asks`` (doc_id, root, m, g) are documents that meet the group g, ``members``
    (doc_id, root, g) those in it; both are stored."""
    spark = docs.sparkSession
    cells = asks.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("m") / PART_SHINGLES), F.lit(1)).cast("int").alias("cells"))
    cells = small(cut_lineage(spark, cells, "cells"))
    cell = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
    rows = asks.join(cells, "g").select("g", cell.alias("cell"), "doc_id", "root", F.lit(True).alias("asks")).unionByName(
        members.join(cells, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "doc_id", "root", F.lit(False).alias("asks")))
    rows = cut_lineage(spark, rows, "cell-rows")
    # Texts travel, which are narrower than their sets.
    met = meeting(docs, rows, "doc_id").select("g", "cell", "asks", "doc_id", "root", "text")
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for _, cell in groupby(columns(batches), key=lambda r: r[:2]):
                sides: tuple[list, list] = ([], [])
                for _, _, asking, doc_id, root, text in cell:
                    t = shingles(text, width)
                    if len(t):
                        sides[asking].append((doc_id, root, t))
                if sides[0] and sides[1]:
                    yield from cell_links(*sides, percent)

        yield from emit(links(), schema)

    return met.repartition("g", "cell").sortWithinPartitions("g", "cell").mapInArrow(run, "x long, y long").distinct()


def components(edges: DataFrame, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(node, root): the smallest node reachable over the edges. Rounds of least neighbours and jumps, each stored."""
    spark = edges.sparkSession
    a, b = names
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).union(edges.select(F.col(b), F.col(a)))
    both = cut_lineage(spark, both.filter("node <> next").distinct(), "edges")
    state = cut_lineage(spark, both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("next"), F.col("root").alias("of")), "next").groupBy("node").agg(F.min("of").alias("of"))
        least = state.join(near, "node").select("node", F.least("root", "of").alias("root"), F.col("root").alias("before"))
        # Jump: the root of one's root, which is at most one's own.
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = least.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), "before")
        moved = cut_lineage(spark, moved, "roots")
        state = moved.select("node", "root")
        if moved.filter("root <> before").isEmpty():
            return state


def _fits(m_least: str, m_most: str, own: str, n_least: str, n_most: str, other: str, percent: int) -> str:
    """SQL: sets of m_least to m_most and sets of n_least to n_most may link; ``own`` and ``other`` are their sizes without
    the leading shingles that no other group leads with.

    Of the set whose leading part ends first, the other one leads with all leading shingles that both hold, so that the
    intersection is within that one's own or other. The least overlap grows with both sizes.
    """
    p = percent / 100
    low, high = f"greatest({n_least}, ceil({p} * {m_least}))", f"least({n_most}, floor({m_most} / {p}))"
    return f"({low} <= {high} AND greatest({own}, {other}) >= {percent / (100 + percent)} * ({m_least} + {low}) - 1e-6)"


def _bounded(shared: str, m: str, n_least: str, n_most: str, percent: int) -> str:
    """SQL: a set of m may link with one of n_least to n_most, given so many shared leading shingles.

    Of the set whose leading part ends first, fewer than 0.75 of its size are left beyond it, and all that both share up
    to there is counted. So shared + 0.75 of the larger size must reach the least overlap, for some size between the
    limits; the difference is convex in that size, so its ends decide.
    """
    p = percent / 100
    low, high = f"greatest({n_least}, ceil({p} * {m}))", f"least({n_most}, floor({m} / {p}))"
    room = lambda n: f"{shared} + {p} * greatest({m}, {n}) >= {percent / (100 + percent)} * ({m} + {n}) - 1e-6"
    return f"({low} <= {high}) AND (({room(low)}) OR ({room(high)}))"


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable over links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    sets = cut_lineage(spark, _sets(docs, width, percent), "sets")
    known = sets.filter("doc_id IS NOT NULL")
    classes = known.filter("m > 0").groupBy("m", "a", "b").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    classes = cut_lineage(spark, classes, "classes")
    nodes = cut_lineage(spark, classes.groupBy("rep").agg(F.min("keys").alias("keys"), F.min("m").alias("m_least"), F.max("m").alias("m_most")), "nodes")

    # Similar documents: those of the same least shingles, and of them the one that shares most.
    keyed = nodes.select("rep", "m_least", "m_most", F.posexplode("keys").alias("hash", "key"))
    often = keyed.groupBy("hash", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(often, ["hash", "key"])
    keyed = cut_lineage(spark, keyed.join(keyed.groupBy("rep").agg(F.sum("n").alias("shares")), "rep").drop("n"), "least-shingles")
    leaders = keyed.groupBy("hash", "key").agg(F.max(F.struct("shares", "rep", "m_least", "m_most")).alias("leader"))
    pairs = (keyed.join(leaders, ["hash", "key"]).filter(f"rep <> leader.rep AND {percent} * greatest(m_least, leader.m_least) <= 100 * least(m_most, leader.m_most)")
             .groupBy(F.col("rep").alias("doc_id"), F.col("leader.rep").alias("g")).agg(F.count("*").alias("agree"), F.max("m_most").alias("m")).filter(F.col("agree") >= AGREE))
    pairs = cut_lineage(spark, pairs, "star-pairs")
    stars = _linked(docs, pairs.withColumn("root", F.col("doc_id")), pairs.select(F.col("g").alias("doc_id"), F.col("g").alias("root"), "g").distinct(), width, percent)
    roots = components(stars.unionByName(_versions(known, classes)))

    # Groups: a star, and who is most like one of it; in parts of bounded size.
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    like = pairs.groupBy(F.col("doc_id").alias("rep")).agg(F.max_by("g", F.struct("agree", "g")).alias("like"))
    member = (nodes.drop("keys").join(of("rep"), "rep", "left").join(like, "rep", "left").join(of("like"), "like", "left")
              .select("rep", "m_least", "m_most", F.coalesce("rep_root", "rep").alias("root"), F.coalesce("rep_root", "like_root", "like", "rep").alias("head")))
    member = cut_lineage(spark, member, "heads")
    parts = member.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("m_most") / PART_SHINGLES)).cast("int").alias("parts")).filter("parts > 1")
    named = F.when(F.col("parts").isNull(), F.col("head")).otherwise(F.xxhash64("head", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    member = member.join(small(cut_lineage(spark, parts, "parts")), "head", "left").withColumn("g", named).select("rep", "root", "g", "m_least", "m_most")
    member = cut_lineage(spark, member, "members")
    group = cut_lineage(spark, member.groupBy("g").agg(F.count("*").alias("size"), F.min("m_least").alias("g_least"), F.max("m_most").alias("g_most"),
                                                       F.min("root").alias("g_root_0"), F.max("root").alias("g_root_1")), "groups")

    # The matrix: shingles that lead sets of at least two groups.
    one = ["doc_id", "m", "a", "b"]
    ours = classes.join(member.select("rep", "g"), "rep").select(F.col("rep").alias("doc_id"), "m", "a", "b", "g")
    ours = known.select(*one, file_of().alias("file")).join(ours, one).groupBy(*one, "g").agg(F.min("file").alias("file"))
    ours = cut_lineage(spark, ours, "sets-of-groups")
    # To be counted, a few other sets do no harm.
    counted = known.filter(hashed_in(ours.select(F.xxhash64(*one).alias("set")))(F.xxhash64(*one)))
    leads = meeting_by_file(known, ours, one)
    total = int(classes.agg(F.coalesce(F.sum(F.col("m") - F.ceil(F.col("m") * percent / 100) + 1), F.lit(0))).first()[0])
    rows = cut_lineage(spark, _matrix_rows(spark, leads, docs, _common(counted, COUNTED * total), total, width, percent), "matrix-rows")
    # With each set's size without the leading shingles left out. A document with several versions spans sizes, and counts
    # as its largest.
    left_out = F.col("m_least") - F.ceil(F.col("m_least") * percent / 100) + 1 - F.col("n")
    open_size = F.when(F.col("m_least") == F.col("m_most"), F.col("m_least") - left_out).otherwise(F.col("m_most"))
    sized = (rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(member.withColumnRenamed("rep", "doc_id"), "doc_id")
             .join(group.select("g", "size"), "g").select("doc_id", "size", "root", F.col("m_least").alias("m_0"), F.col("m_most").alias("m_1"), open_size.alias("own")))
    sized = small(cut_lineage(spark, sized, "sizes"))
    asking = cut_lineage(spark, rows.join(sized, "doc_id"), "asking")
    matrix = (asking.groupBy(F.col("token").alias("held"), F.col("g").alias("of")).agg(
        F.first("size").alias("h_size"), F.min("m_0").alias("h_0"), F.max("m_1").alias("h_1"), F.max("own").alias("h_own"), F.min("root").alias("h_root_0"), F.max("root").alias("h_root_1")))

    # Which groups a document's bound lets open; of two groups the smaller one's documents ask.
    smaller = ("token = held AND (size < h_size OR size = h_size AND g < of) AND NOT (h_root_0 = root AND h_root_1 = root) AND "
               + _fits("m_0", "m_1", "own", "h_0", "h_1", "h_own", percent))
    met = (asking.join(matrix, F.expr(smaller)).groupBy("doc_id", "root", "of").agg(F.count("*").alias("shared"), F.first("m_0").alias("m_0"), F.first("m_1").alias("m_1"))
           .withColumnRenamed("of", "g").join(small(group), "g"))
    # A document with several versions spans sizes; it is then let through unbounded.
    opened = met.filter(f"m_0 <> m_1 OR ({_bounded('shared', 'm_0', 'g_least', 'g_most', percent)})").select("doc_id", "root", F.col("m_1").alias("m"), "g")
    # Members of one group that no star connects meet each other too.
    inside = member.join(small(group.filter("g_root_0 <> g_root_1").select("g")), "g", "left_semi").select(F.col("rep").alias("doc_id"), "root", F.col("m_most").alias("m"), "g")
    opened = cut_lineage(spark, opened.unionByName(inside), "opened")
    links = _linked(docs, opened, member.select(F.col("rep").alias("doc_id"), "root", "g"), width, percent)
    last = components(links)

    # Back to rows: a row's set, its class's document, that one's star, the star's root.
    final = member.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("rep", F.coalesce("last", "root").alias("root"))
    linked = cut_lineage(spark, classes.join(final, "rep").select("m", "a", "b", "root"), "classes-linked")
    per_row = known.select("doc_id", "m", "a", "b").join(linked, ["m", "a", "b"], "left").select("doc_id", F.col("m").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    # Roots are the smallest representatives, which are the smallest documents of their components.
    return per_row.unionByName(sets.filter("doc_id IS NULL").select("doc_id", F.col("m").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _versions(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y): representatives of the sets of each id that has several."""
    several = known.filter("m > 0").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = small(cut_lineage(known.sparkSession, several, "repeated-ids"))
    of = known.select("doc_id", "m", "a", "b").join(several, "doc_id", "left_semi").join(classes.select("m", "a", "b", "rep"), ["m", "a", "b"])
    least = of.groupBy("doc_id").agg(F.min("rep").alias("x"))
    return of.join(least, "doc_id").select("x", F.col("rep").alias("y")).filter("x <> y").distinct()
