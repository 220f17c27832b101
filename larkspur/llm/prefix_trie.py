"""Trie of conversation prefixes.

A turn becomes 20 bytes: a 128-bit digest of role and text, and the number of words; a conversation is their sequence.
Equal conversations are grouped first (partial aggregates), so a conversation that very many rows repeat is one row from
there on. The distinct sequences are dealt by range, in parts of about ``CELLS`` turns. A task numbers its turns in order
and takes its rows as matrices of turn numbers, ``WIDTH`` depths wide and padded behind a sequence's end, so a long
conversation widens no other; numpy's lexsort orders the rows, and the changes from row to row, accumulated by OR along
the depths, mark where nodes start. At each depth reduceat sums what the rows of a node bring.

All sums are over rows and over starts, so they add up across parts. Only the nodes on the path of a part's first or last
row can go on in another part: they come back with their digest and are summed by it. How many turns the first row of a
part shares with the last row of the part before it, one row a part, tells which of its nodes start there and whether
that last row ends in a leaf. Nodes under such a node look up its smallest member.

The ids that end at a node are joined in pieces of ``PIECE`` possible ids each, in order, and one hash takes piece after
piece, so a node at which a third of all conversations end needs memory for one piece.

Defined cases: a null role or text is empty; turns of equal number go by digest; repeated rows are turns of their own; a
row without a conversation id belongs to none and is left out; an empty table gives no rows (there is no root without a
member); an empty text is a turn of no words; further columns are ignored. A conversation has to fit a task, at 20
bytes a turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checksums import CRC, crc_sql
from .store import staged
from .words import tidy

ID, WIDTH, CELLS, PIECE_BITS = 20, 32, 1 << 19, 16
#: Boundary nodes that are broadcast at most; there are two paths a part.
MOST = 100_000

_ENDS = "path binary, n long, first long, ends string"
_NODES = (
    "part int, depth long, key binary, parent_key binary, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, all_tokens long, own_tokens long, "
    "ends string, on_first boolean, on_last boolean, first_path binary, last_path binary, tail array<long>"
)


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, path: the first turns of the conversation that heads its group, then its own behind as many; how many is
    its checksum modulo ``shared``."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    number = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 8, "0")
    conv = F.col("conv_id").cast("long")
    rows = turns.where(conv.isNotNull()).select(conv.alias("conv_id"), (conv - F.pmod(conv, F.lit(group))).alias("head"), F.struct(F.col("turn").isNotNull(), "turn", F.concat(digest, number).alias("id")).alias("turn"))
    of = rows.repartition("head").groupBy("head", "conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x["id"]).alias("ids"))
    heads = of.where("head = conv_id").select("head", F.slice("ids", 1, shared - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    ids = F.concat(F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), h), F.slice("ids", h + 1, F.size("ids")))
    return of.join(heads, "head", "left").select("conv_id", F.unhex(F.array_join(ids, "")).alias("path"))


def _hashed(batches):
    """Rows sorted by path and piece; one row a path."""
    path = sha = None
    n = first = 0
    done = [], [], [], []

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.int64()), pa.array(done[3], pa.string())], ["path", "n", "first", "ends"])
        for x in done:
            x.clear()
        return out

    def close():
        for x, v in zip(done, (path, n, first, sha.hexdigest())):
            x.append(v)

    for b in batches:
        for p, m, lo, piece in zip(*(b.column(k).to_pylist() for k in range(4))):
            if p != path or sha is None:
                if sha is not None:
                    close()
                path, sha, n, first = p, hashlib.sha256(), 0, lo
            else:
                sha.update(b",")
            sha.update(piece.encode())
            n += m
        if len(done[0]) > 10_000:
            yield batch()
    if sha is not None:
        close()
    yield batch()


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path, n (conversations), first (smallest id), ends (hash of the ids)."""
    piece = F.expr(f"shiftright(conv_id, {PIECE_BITS})")
    ids = convs.groupBy("path", piece.alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    rows = ids.select("path", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"), "piece")
    rows = rows.repartition("path").sortWithinPartitions("path", "piece").drop("piece")
    return rows.mapInArrow(_hashed, _ENDS)


def _matrix(number: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, tile: int) -> np.ndarray:
    """Turn numbers of these rows at the depths of a tile, -1 behind the end."""
    at = start[rows, None] + tile * WIDTH + np.arange(WIDTH)
    return np.where(tile * WIDTH + np.arange(WIDTH) < size[rows, None], number[np.minimum(at, len(number) - 1)], -1)


def _ordered(number: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows in the order of their sequences: the deepest tile first, each sort stable."""
    order = np.arange(len(size))
    for tile in range(-(-int(size.max(initial=0)) // WIDTH) - 1, -1, -1):
        on = size[order] > tile * WIDTH
        rows = order[on]
        order = np.concatenate([order[~on], rows[np.lexsort(_matrix(number, start, size, rows, tile).T[::-1])]])
    return order


def _starts(number: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of ordered rows, the depth from which on a row's nodes start with it."""
    count, node = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for tile in range(-(-int(size.max(initial=0)) // WIDTH)):
        rows = np.flatnonzero(size > tile * WIDTH)
        m = _matrix(number, start, size, rows, tile)
        change = np.ones(m.shape, bool)
        change[1:] = m[1:] != m[:-1]
        change[1:, 0] |= node[rows[1:]] != node[rows[:-1]]
        np.logical_or.accumulate(change, axis=1, out=change)
        count[rows] += (change & (m >= 0)).sum(1)
        node[rows] = np.cumsum(change[:, -1])
    return size - count + 1


def _keys(path: bytes) -> list[bytes]:
    """A digest for each prefix."""
    out = [b""]
    for i in range(0, len(path), ID):
        out.append(hashlib.blake2b(out[-1] + path[i : i + ID], digest_size=16).digest())
    return out


def _nodes(batches):
    """The nodes of a part: rows path, n, first, ends."""
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is None or not len(t):
        return
    path = t["path"].to_pylist()
    n, least, ends = t["n"].to_numpy(), t["first"].to_numpy(), t["ends"].to_pylist()
    size = np.array([len(p) // ID for p in path], np.int64)
    flat = np.frombuffer(b"".join(path), f"S{ID}")
    number = np.unique(flat, return_inverse=True)[1] if len(flat) else np.zeros(1, np.int64)
    words = np.frombuffer(b"".join(path), np.dtype([("id", "V16"), ("n", ">u4")]))["n"].astype(np.int64)
    total = np.append(0, np.cumsum(words))
    start = np.cumsum(size) - size
    order = _ordered(number, start, size)
    start, size, n, least = start[order], size[order], n[order], least[order]
    ends = np.array(ends, object)[order]
    new = _starts(number, start, size)
    leaf = np.append(new[1:] <= size[:-1], False)  # of the last row the next part knows
    new[0] = size[0] + 1  # of the first one the part before it
    first_path, last_path = path[order[0]], path[order[-1]]
    keys = _keys(first_path), _keys(last_path)
    part = TaskContext.get().partitionId()
    behind = lambda rows, d: total[start[rows] + size[rows]] - total[start[rows] + np.minimum(np.maximum(d, 1) - 1, size[rows])]
    empty = lambda kind: pa.nulls(len(conv), kind)

    rows, parent = np.arange(len(size)), np.zeros(len(size), np.int64)
    edge = np.zeros(len(size), np.int64)  # 1: the node of the row at the last depth is on the first row's path, 2: on the last one's
    for d in range(int(size.max()) + 1):
        on = size[rows] >= d
        rows, parent, edge = rows[on], parent[on], edge[on]
        cut = np.flatnonzero((new[rows] <= d) | (rows == 0)) if d else np.zeros(1, np.int64)
        conv = np.minimum.reduceat(least[rows], cut)
        count = np.diff(np.append(cut, len(rows)))
        top = rows[cut]
        here = (top == 0) * 1 + (np.append(rows[cut[1:] - 1], rows[-1]) == len(size) - 1) * 2
        key = np.where(here & 1, keys[0][d] if d < len(keys[0]) else None, np.where(here & 2, keys[1][d] if d < len(keys[1]) else None, None))
        above = np.full(len(cut), None, object)
        if d:
            above = np.where(edge[cut] & 1, keys[0][d - 1] if d <= len(keys[0]) else None, np.where(edge[cut] & 2, keys[1][d - 1] if d <= len(keys[1]) else None, None))
        parents = pa.array(parent[cut]) if d else empty(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cut), part, np.int32)), pa.array(np.full(len(cut), d)), pa.array(key.tolist(), pa.binary()), pa.array(above.tolist(), pa.binary()), parents, pa.array(conv),
                pa.array(np.add.reduceat(n[rows], cut)), pa.array(np.add.reduceat(((size[rows] > d) & (new[rows] <= d + 1)).astype(np.int64), cut)), pa.array(np.add.reduceat(leaf[rows].astype(np.int64), cut)),
                pa.array(np.add.reduceat(n[rows] * behind(rows, d), cut)), pa.array(np.add.reduceat(behind(rows, np.maximum(new[rows], d)), cut)),
                pa.array([e if z == d else None for e, z in zip(ends[top], size[top])], pa.string()), pa.array(here & 1 > 0), pa.array(here & 2 > 0),
                empty(pa.binary()), empty(pa.binary()), empty(pa.list_(pa.int64())),
            ],
            _COLUMNS,
        )
        parent, edge = np.repeat(conv, count), np.repeat(here, count)
    tail = [int(behind(np.zeros(1, int), k)[0]) for k in range(int(size[0]) + 2)]
    values = [part, -1] + [None] * 12 + [first_path, last_path, tail]
    yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, values))], _SCHEMA)


_COLUMNS = [c.split()[0] for c in _NODES.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _NODES.split(", ")])


def _shared(a: Column, b: Column) -> Column:
    """How many turns two paths begin with alike."""
    most = (F.least(F.length(a), F.length(b)) / ID).cast("int")
    same = F.transform(F.sequence(F.lit(1), most), lambda i: F.substring(a, i * ID - (ID - 1), F.lit(ID)) == F.substring(b, i * ID - (ID - 1), F.lit(ID)))
    at = F.array_position(same, False).cast("int")
    return F.when(b.isNotNull() & (most > 0), F.when(at == 0, most).otherwise(at - 1)).otherwise(0)


def trie(paths: DataFrame) -> DataFrame:
    """path, n, first, ends (distinct paths) -> a row a node."""
    spark = paths.sparkSession
    cells = paths.agg(F.sum(F.length("path") / ID + 1)).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(cells) // CELLS))
    nodes = staged(paths.select("path", "n", "first", "ends").repartitionByRange(parts, "path").mapInArrow(tidy(_nodes), _NODES), "nodes")
    by_part = Window.orderBy("part")  # one row a part
    edges = nodes.where("depth < 0").select("part", "last_path", "tail", _shared(F.col("first_path"), F.lag("last_path").over(by_part)).alias("shared"))
    goes_on = F.coalesce(F.lead("shared").over(by_part) == F.length("last_path") / ID, F.lit(False))
    edges = staged(edges.select("part", "tail", "shared", goes_on.alias("goes_on")), "edges")
    real = nodes.where("depth >= 0").drop("first_path", "last_path", "tail")
    open_ = real.where("key IS NOT NULL").join(edges, "part")
    size = F.size("tail") - 2
    started = F.when(F.col("on_first"), F.col("tail")[F.least(F.greatest(F.col("depth"), F.col("shared") + 1), size + 1).cast("int")]).otherwise(0)
    child = F.when(F.col("on_first") & (F.col("depth") >= F.col("shared")) & (F.col("depth") < size), 1).otherwise(0)
    leaf = F.when(F.col("on_last") & ~F.col("goes_on"), 1).otherwise(0)
    sums = {"n_convs": F.col("n_convs"), "n_children": F.col("n_children") + child, "n_leaves": F.col("n_leaves") + leaf, "all_tokens": F.col("all_tokens"), "own_tokens": F.col("own_tokens") + started}
    whole = open_.groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *[F.sum(v).alias(k) for k, v in sums.items()])
    whole = staged(whole, "boundary")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens", "ends"]
    known = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    known = F.broadcast(known) if whole.count() <= MOST else known
    inner = real.where("key IS NULL")
    under = inner.where("parent_key IS NOT NULL").select(*columns, "parent_key").unionByName(whole.select(*columns, "parent_key")).join(known, "parent_key", "left")
    out = inner.where("parent_key IS NULL").select(*columns, "parent_conv_id").unionByName(under.select(*columns, "parent_conv_id"))
    nobody = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_tokens") - F.col("own_tokens")).alias("saved_tokens"), F.coalesce("ends", nobody).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(staged(distinct_paths(rebuilt(turns)), "paths"))


OP13_SQL = rf"""
WITH {CRC}, o AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (SELECT conv_id, s, ({crc_sql("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM o, crc
), c AS (
  SELECT k.conv_id, list_concat(coalesce(b.s, [])[1:k.h], k.s[k.h + 1:]) AS s FROM k LEFT JOIN o b ON b.conv_id = k.conv_id - k.conv_id % 20
), m AS (SELECT conv_id, s, d, s[1:d] AS p FROM c, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)
), n AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM m GROUP BY p, d
), w AS MATERIALIZED (
  SELECT p, d, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n
), x AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), t AS (
  SELECT w.p[1:a] AS p, sum(w.saved) AS saved, count(*) FILTER (x.p IS NULL) AS leaves FROM w LEFT JOIN x ON w.p = x.p, LATERAL (SELECT unnest(range(0, w.d + 1)) AS a) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(x.n_children, 0) AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN t ON n.p = t.p LEFT JOIN x ON n.p = x.p LEFT JOIN n u ON n.d > 0 AND u.p = n.p[1:n.d - 1]
"""
