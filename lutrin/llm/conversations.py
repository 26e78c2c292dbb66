"""Prefix trie of conversations by union-find over sorted-neighbour edges.

A conversation is a key: the 16-byte digests of its turns (role and text) in order. Keys are sorted over all tasks; neighbours in that
order are joined by an edge whose depth is the number of turns they share. Inside a chunk of a sorted partition the edges are taken
in descending depth: union-find merges the two components of an edge, and every merge creates (or widens) the branching node at that
depth; what hangs below a finished component is complete and leaves the chunk as rows. Nodes on the first and the last key of a chunk may go on in
the neighbouring chunk. They are contracted to two paths with the sums of all that is closed below them, and paths of FAN_IN partitions are merged
by the same procedure, round after round, until one group holds the rest. So a task sees one bounded chunk of keys, or two paths
per chunk, never a whole subtree.

A conversation with a very common sequence stands in many partitions (the order goes on by conv_id). The digest over the members that end in a node is
taken where the node lies inside one chunk; else the ids travel as packed runs and are hashed as a stream, run by run in order.

Defined results: rows without a conv_id belong to no conversation; a null turn comes first; null role or text is empty; rows of one conversation
with equal turn are ordered by the digest of role and text and all kept; an empty table has no nodes. A conversation is one row of 28 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lutrin.llm.common import written

DIGEST = 16
CHUNK_ROWS = 20_000
CHUNK_BYTES = 32 << 20
FAN_IN = 64
ROWS_PER_PARTITION = 50_000
WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
ELSEWHERE = "?"  # the digest of the ends comes from the packed runs

OUT = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                 ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("id", pa.binary()),
                 ("up", pa.binary()), ("part", pa.string()), ("at", pa.int64()), ("chunk", pa.int64()), ("key", pa.binary()),
                 ("words", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(pa.int64()))), ("sum_ends", pa.list_(pa.string()))])


def turn_digest(role: Column, text: Column) -> Column:
    """Sixteen bytes that tell turns apart by role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns as (digest, words) in order."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
                 F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("words")).alias("row"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))))


def with_heads(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c after the first h turns of c - c % every (floored), h = crc32(decimal c) % most, in place of its own first h."""
    own = written(own)
    heads = own.filter(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("giver"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    giver = F.try_subtract(F.col("conv_id"), F.pmod("conv_id", F.lit(every)))
    rows = own.withColumn("giver", giver).withColumn("h", h).join(heads, "giver", "left")
    none = F.slice("turns", 1, F.lit(0))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
                                           F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@dataclass
class Sum:
    """What is known of one node so far: closed members, their smallest id, closed children and their rows."""

    n: int = 0
    low: int = 1 << 63
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    children: list = field(default_factory=list)

    def hang(self, node: Node) -> None:
        self.n += node.n
        self.low = min(self.low, node.low)
        self.kids += 1
        self.leaves += node.leaves
        self.saved += node.saved
        self.children.append(node)

    def add(self, other: Sum) -> None:
        self.n += other.n
        self.low = min(self.low, other.low)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.children += other.children


@dataclass
class Node:
    """A finished node."""

    low: int
    depth: int
    n: int
    kids: int
    leaves: int
    saved: int
    ends: str | None
    id: bytes | None


@dataclass
class Path:
    """A key with its words per turn and the sums of the nodes on it, by depth."""

    key: bytes
    words: list[int]
    sums: dict[int, Sum]

    @property
    def depth(self) -> int:
        return len(self.key) // DIGEST


def shared_depth(a: bytes, b: bytes) -> int:
    """Number of leading turns both keys have."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    low = 0  # equal up to low, different at n
    while n - low > 1:
        middle = (low + n) // 2
        if a[low * DIGEST:middle * DIGEST] == b[low * DIGEST:middle * DIGEST]:
            low = middle
        else:
            n = middle
    return low


def prefix_ids(key: bytes) -> list[bytes]:
    """A digest of every prefix, from the empty one."""
    running, out = hashlib.blake2b(digest_size=DIGEST), []
    out.append(running.digest())
    for at in range(0, len(key), DIGEST):
        running.update(key[at:at + DIGEST])
        out.append(running.copy().digest())
    return out


class Rows:
    """Output rows of one chunk or group, handed out as record batches."""

    def __init__(self, part: str):
        self.part, self.columns = part, {name: [] for name in OUT.names}

    def add(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def node(self, node: Node, parent: int | None = None, up: bytes | None = None) -> None:
        ends = NO_ENDS if node.ends is None else None if node.ends == ELSEWHERE else node.ends
        self.add(kind="node", conv_id=node.low, depth=node.depth, parent_conv_id=parent, n_convs=node.n, n_children=node.kids, n_leaves=node.leaves,
                 saved_tokens=node.saved, ends=ends, id=node.id, up=up, part=self.part)

    def path(self, at: int, path: Path) -> None:
        sums = sorted(path.sums.items())
        self.add(kind="path", part=self.part, at=at, key=path.key, words=path.words,
                 sums=[[d, s.n, s.low if s.n else -1, s.kids, s.leaves, s.saved] for d, s in sums], sum_ends=[s.ends for _, s in sums])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(self.columns, schema=OUT)


def contract(paths: list[Path], rows: Rows, last_round: bool, with_ids: bool) -> list[Path]:
    """Merges the components of sorted paths; finished nodes go to `rows`, what may go on in a neighbour is returned.

    In the last round nothing goes on: all nodes are finished, the root too.
    """
    folded: list[Path] = []
    for path in paths:
        if folded and folded[-1].key == path.key:
            for depth, s in path.sums.items():
                folded[-1].sums.setdefault(depth, Sum()).add(s)
        else:
            folded.append(path)
    paths, end = folded, len(folded) - 1
    edges = [shared_depth(a.key, b.key) for a, b in zip(paths, paths[1:], strict=False)]
    leader, at = list(range(len(paths))), [p.depth for p in paths]  # at: the depth down to which a component is finished
    ids = {i: prefix_ids(paths[i].key) for i in range(len(paths)) if with_ids or not last_round and i in (0, end)}
    goes_on = (lambda i: False) if last_round else (lambda i: i in (0, end))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    def finish(i: int, depth: int) -> Node | None:
        sums, words, node = paths[i].sums, paths[i].words, None
        for e in range(at[i], depth, -1):
            s = sums.pop(e, None) or Sum()
            if node:
                s.hang(node)
            for child in s.children:
                rows.node(child, s.low)
            saved = s.saved + (s.n - 1) * words[e - 1] if e else s.saved
            node = Node(s.low, e, s.n, s.kids, s.leaves if s.kids else 1, saved, s.ends, ids[i][e] if with_ids else None)
        at[i] = depth
        return node

    for i in sorted(range(end), key=lambda i: -edges[i]):  # stable: left to right among edges of one depth
        depth, a, b = edges[i], find(i), find(i + 1)
        for side in (a, b):
            if not goes_on(side) and at[side] > depth:
                paths[side].sums.setdefault(depth, Sum()).hang(finish(side, depth))
        kept, gone = (b, a) if goes_on(b) and not goes_on(a) else (a, b)
        for e in [e for e in paths[gone].sums if e <= depth]:
            paths[kept].sums.setdefault(e, Sum()).add(paths[gone].sums.pop(e))
        leader[gone] = kept
        at[kept] = min(at[kept], max(depth, at[kept] if goes_on(kept) else depth))
    if last_round:
        if paths:
            rows.node(finish(find(0), -1))
        return []
    left = [paths[i] for i in sorted({0, end})]
    for i, path in zip(sorted({0, end}), left, strict=True):
        for depth, s in path.sums.items():
            if s.children:
                rows.add(kind="open", part=rows.part, id=ids[i][depth])
            for child in s.children:
                rows.node(child, up=ids[i][depth])
            s.children = []
    return left


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[int], list[int]]]]:
    """Sorted (key, words, ids) of at most CHUNK_ROWS conversations; equal keys of a chunk stand together."""
    chunk, rows, held = [], 0, 0
    for batch in batches:
        for key, words, conv_id in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "conv_id")), strict=True):
            if chunk and chunk[-1][0] == key:
                chunk[-1][2].append(conv_id)
            else:
                chunk.append((key, words, [conv_id]))
                held += len(key) * 2
            rows += 1
            if rows >= CHUNK_ROWS or held >= CHUNK_BYTES:
                yield chunk
                chunk, rows, held = [], 0, 0
    if chunk:
        yield chunk


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes and contracted paths of every chunk of a sorted partition."""
    at = TaskContext.get().partitionId()
    for number, chunk in enumerate(_chunks(batches)):
        rows, paths = Rows(f"0.{at}.{number}"), []
        for i, (key, words, ids) in enumerate(chunk):
            ends = ELSEWHERE if i in (0, len(chunk) - 1) else hashlib.sha256(_joined(ids)).hexdigest()
            if ends == ELSEWHERE:
                rows.add(kind="ends", id=prefix_ids(key)[-1], at=at, chunk=number, key=_joined(ids))
            paths.append(Path(key, words, {len(key) // DIGEST: Sum(len(ids), ids[0], ends=ends)}))
        for path in contract(paths, rows, last_round=False, with_ids=False):
            rows.path(at, path)
        yield rows.batch()


def _merger(round_: int, last_round: bool):
    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        at = group["at"][0].as_py() // FAN_IN
        paths = []
        for key, words, sums, ends in zip(*(group[c].to_pylist() for c in ("key", "words", "sums", "sum_ends")), strict=True):
            paths.append(Path(key, words, {d: Sum(n, low if n else 1 << 63, kids, leaves, saved, e)
                                           for (d, n, low, kids, leaves, saved), e in zip(sums, ends, strict=True)}))
        rows = Rows(f"{round_}.{at}")
        for path in contract(paths, rows, last_round, with_ids=True):
            rows.path(at, path)
        return pa.Table.from_batches([rows.batch()])
    return merged


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packed runs of every id, which come in order; one run is held at a time."""
    now, running, out = None, None, []
    for batch in batches:
        for id_, key in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if id_ != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = id_, hashlib.sha256(key)
            else:
                running.update(b"," + key)
        yield pa.RecordBatch.from_pydict({"id": [i for i, _ in out], "ends_found": [d for _, d in out]}, schema=ENDS)
        out = []
    if now is not None:
        yield pa.RecordBatch.from_pydict({"id": [now], "ends_found": [running.hexdigest()]}, schema=ENDS)


ENDS = pa.schema([("id", pa.binary()), ("ends_found", pa.string())])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, turns) rows, one per distinct prefix from the empty one.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    schema = from_arrow_schema(OUT)
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    keys = written(turns.select("conv_id", F.unhex(hexes).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // ROWS_PER_PARTITION))
    done = [written(keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_forests, schema))]
    most = done[0].filter("kind = 'path'").agg(F.max("at")).first()[0]
    groups = 0 if most is None else most + 1
    while groups:
        groups = -(-groups // FAN_IN)
        paths = done[-1].filter("kind = 'path'").select("at", "key", "words", "sums", "sum_ends")
        merged = paths.groupBy(F.expr(f"at div {FAN_IN}")).applyInArrow(_merger(len(done), groups == 1), schema)
        done.append(written(merged))
        groups = 0 if groups == 1 else groups
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    result = ["conv_id", "depth", "parent_conv_id", *columns[2:], "ends"]
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    late = done[0].limit(0)
    for more in done[1:]:
        late = late.unionByName(more)
    lows = late.filter("kind = 'node'").select("id", F.col("conv_id").alias("parent_conv_id"))
    parents = rows.filter("kind = 'open'").select("part", "id").join(lows, "id").select("part", F.col("id").alias("up"), "parent_conv_id")
    nodes = rows.filter("kind = 'node'").select(*result, "id", "up", "part")
    inside = nodes.filter("up is null")
    across = nodes.filter("up is not null").drop("parent_conv_id").join(parents, ["part", "up"]).select(*result, "id", "up", "part")
    packed = done[0].filter("kind = 'ends'").select("id", "at", "chunk", "key")
    hashed = packed.repartition(parts, "id").sortWithinPartitions("id", "at", "chunk").mapInArrow(_hashed_ends, from_arrow_schema(ENDS))
    every = inside.unionByName(across)
    known = every.filter("ends is not null").select(*result)
    looked_up = every.filter("ends is null").drop("ends").join(hashed, "id").withColumnRenamed("ends_found", "ends").select(*result)
    return known.unionByName(looked_up).withColumnRenamed("ends", "ends_sha256")


TRIE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS seq FROM turns GROUP BY conv_id),
heads AS (
  SELECT *, conv_id - ((conv_id % 20) + 20) % 20 AS giver,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
      4294967295::BIGINT) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) AS seq
  FROM heads a LEFT JOIN own b ON b.conv_id = a.giver),
prefixes AS (
  SELECT conv_id, len(seq) AS size, d AS depth, list_slice(seq, 1, d) AS prefix
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(prefix[depth]).text, '[^\x20\x09-\x0D]+')) END AS own
  FROM prefixes GROUP BY prefix, depth),
kids AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.prefix = nodes.prefix),
sums AS (
  SELECT list_slice(prefix, 1, d) AS prefix, sum((n_children = 0)::INT)::BIGINT AS leaves, sum(own)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM marked) GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, m.ends AS ends_sha256
FROM marked m JOIN sums s ON s.prefix = m.prefix
LEFT JOIN nodes p ON p.depth = m.depth - 1 AND p.prefix = list_slice(m.prefix, 1, m.depth - 1)
"""
