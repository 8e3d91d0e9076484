"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt by ranges of their ids and cut into shards. A shard keeps a bitset of its conversations for each
(position, turn); a node's bitset, cut with the bitset of a turn at the next position, is a child's. Walking so depth first
gives each node's number of members (bits set), its least member and the list of the conversations that end there. Nodes of
all shards meet by a 128-bit key of their path, so a prefix that a third of all conversations share comes as one row a shard.
Sums over subtrees take as many rounds as the depth has binary digits: in round k a node adds what its descendants 2**k
below have gathered; a shard knows the keys of those ancestors, so that no round looks for them.

Turns stand by number, those without one first; equal numbers by the MD5 digest of role and text. A null role or text is
empty. Rows without a conversation id belong to none. Rows that repeat are turns of their own. A conversation of no turns
(left by splicing) ends at the root. Texts are read whole and travel as digests; a conversation's digests fit one task. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import columns, emit

# Conversations and turns at which a shard is full.
CONVERSATIONS, TURNS = 4096, 200_000
# Ids in one stretch of an end list.
STRETCH = 512
ROOT = bytes(16)
# Parents of more children than one in so many of all nodes are sent to every task; there are fewer of them than that.
SENT = 100_000

Turn = tuple[bytes, int]
Sequence = tuple[int, list[Turn]]


def turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary")))))


def spliced(family: list[Sequence], base: int, heads: int) -> Iterator[Sequence]:
    """Each conversation with its first turns replaced by as many of conversation ``base``: crc32 of the id modulo
    ``heads``."""
    donor = next((turns for c, turns in family if c == base), [])
    for c, turns in family:
        h = zlib.crc32(str(c).encode()) % heads
        yield c, donor[:h] + turns[h:]


def shards(rows: Iterable[tuple[int, int, bytes, int]], heads: int) -> Iterator[list[Sequence]]:
    """Conversations from rows (base, conv_id, turn, words) that stand in order, in lists of bounded size."""
    held: list[Sequence] = []
    size = 0
    for base, family in groupby(rows, key=lambda r: r[0]):
        own = [(c, [(key, words) for _, _, key, words in turns]) for c, turns in groupby(family, key=lambda r: r[1])]
        for c, turns in spliced(own, base, heads):
            held.append((c, turns))
            size += len(turns)
            if len(held) >= CONVERSATIONS or size >= TURNS:
                yield held
                held, size = [], 0
    if held:
        yield held


def walk(shard: list[Sequence]) -> Iterator[tuple]:
    """Nodes of a shard's trie: key, depth, keys of the ancestors 1, 2, 4, ... above, members, least member, words of the
    last turn, stretches of ids that end there."""
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for i, (_, turns) in enumerate(shard):
        bit = 1 << i
        ends[len(turns)] = ends.get(len(turns), 0) | bit
        for at, (key, _) in enumerate(turns):
            postings[at, key] = postings.get((at, key), 0) | bit
    path: list[bytes] = []
    open_nodes = [((1 << len(shard)) - 1, 0, ROOT, 0)]
    while open_nodes:
        members, depth, turn, words = open_nodes.pop()
        del path[depth:]
        path.append(xxhash.xxh3_128_digest(path[-1] + turn) if path else ROOT)
        ending = members & ends.get(depth, 0)
        ups = [path[depth - (1 << k)] for k in range(depth.bit_length())]
        yield path[depth], depth, ups, members.bit_count(), shard[_lowest(members)][0], words, _stretches(shard, ending)
        rest = members ^ ending
        while rest:
            key, n = shard[_lowest(rest)][1][depth]
            child = members & postings[depth, key]
            open_nodes.append((child, depth + 1, key, n))
            rest &= ~child


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _stretches(shard: list[Sequence], bits: int) -> list[dict]:
    ids = []
    while bits:
        ids.append(shard[_lowest(bits)][0])
        bits &= bits - 1
    return [{"first": ids[at], "ids": ",".join(map(str, ids[at: at + STRETCH]))} for at in range(0, len(ids), STRETCH)]


def _shard_nodes(conversations: DataFrame, family: int, heads: int) -> DataFrame:
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter(conv.isNotNull()).select(
        (conv - conv % family).alias("base"), conv.alias("conv_id"), "turn", turn_key(role, text).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    dealt = turns.repartitionByRange("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "key")
    schema = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("ups", pa.list_(pa.binary())), ("n", pa.int64()), ("least", pa.int64()), ("words", pa.int64()),
                        ("ends", pa.list_(pa.struct([("first", pa.int64()), ("ids", pa.string())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit((node for shard in shards(columns(batches), heads) for node in walk(shard)), schema)

    return dealt.select("base", "conv_id", "key", "words").mapInArrow(
        run, "key binary, depth long, ups array<binary>, n long, least long, words long, ends array<struct<first: long, ids: string>>")


def _end_hashes(shard_nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of each node's whole end list, read stretch by stretch."""
    stretches = shard_nodes.select("key", F.explode("ends").alias("part")).select("key", "part.first", "part.ids")
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, parts in groupby(columns(batches), key=lambda r: r[0]):
                digest = hashlib.sha256(next(parts)[2].encode())
                for _, _, ids in parts:
                    digest.update(b"," + ids.encode())
                yield key, digest.hexdigest()

        yield from emit(rows(), schema)

    return stretches.repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 1, heads: int = 1) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (words that members beyond the first need not repeat, over its subtree), ends_sha256.

    With ``family`` and ``heads`` the first crc32(id) % heads turns of each conversation are those of the one whose id is
    the next lower multiple of ``family``. By default conversations stay as they are.
    """
    spark = conversations.sparkSession
    shard_nodes = cut_lineage(spark, _shard_nodes(conversations, family, heads), "shard-nodes")
    nodes = cut_lineage(spark, shard_nodes.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("ups").alias("ups"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.first("words").alias("words")), "nodes")
    total, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    above = lambda k: F.get("ups", F.lit(k))
    children = nodes.filter("depth > 0").groupBy(above(0).alias("key")).agg(F.count("*").alias("n_children"))
    state = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    state = state.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    for k in range((deepest or 0).bit_length()):
        below = state.filter(F.size("ups") > k).groupBy(above(k).alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        grown = state.join(below, "key", "left")
        for total_of, more in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved")):
            grown = grown.withColumn(total_of, F.col(total_of) + F.coalesce(more, F.lit(0)))
        state = cut_lineage(spark, grown.drop("more_leaves", "more_saved"), "subtree-sums")

    # The parent's least member: parents of many children are few and sent, the others meet their children by key.
    parents = state.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    busy = F.col("n_children") > max(1000, total // SENT)
    many, few = parents.filter(busy).drop("n_children"), parents.filter(~busy).drop("n_children")
    kids = state.withColumn("up", above(0))
    known = kids.join(F.broadcast(many), "up").unionByName(kids.join(F.broadcast(many.select("up")), "up", "left_anti").join(few, "up", "left"))
    known = known.join(_end_hashes(shard_nodes), "key", "left")
    return known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
