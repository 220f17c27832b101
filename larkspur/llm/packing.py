"""Best-fit packing of token pieces into sequences of fixed length, certified by lower bounds.

Pieces are dealt at random to partitions of about ``part_rows``; each is packed by best-fit decreasing, and dual-feasible
functions give a lower bound on its number of sequences. Where the count exceeds the bound, the partition gives up the
pieces of its emptiest sequences, as many as the gap plus ``spare``; given-up pieces of all partitions are dealt anew and
packed again, for ``rounds`` rounds at most or until no partition has a gap.

Only (id, piece, length) rows are shuffled, never tokens. Full pieces are sequences by themselves.

Defined cases: a null text counts as empty and is one piece, the end id; a longer document than a sequence is cut into
full pieces and a last one; repeated rows are packed as rows of their own; a null id is carried along; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import staged
from .words import IdLists, WordRows, blocks, kept, tidy, words

LENGTH = 2048
#: What a worker keeps from block to block: words with their ids, and parts of words with theirs; about 70 MB at most.
WORDS_KEPT, PARTS_KEPT, PART_CHARS = 300_000, 300_000, 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """Token ids of distinct words, each found once per worker. The tokenizer drops white space and never joins what white
    space divides, so a text's ids are those of its words in order. A word is cut by the tokenizer's own normalizer and
    pattern, and its parts go to the tokenizer's model."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x["content"] for x in json.load(open(path))["added_tokens"]]
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lists = IdLists()
        self.number = WordRows(self.learn, self.lists.keep, WORDS_KEPT)

    def learn(self, new: list[str]) -> None:
        if len(self.parts) > PARTS_KEPT // 2:  # parts not met since the last time go
            self.parts, self.older = {}, self.parts
        t, model, parts, older = self.tokenizer, self.tokenizer.model, self.parts, self.older
        size, ids = [], []
        for word in new:
            if any(x in word for x in self.special) or not word.isascii():
                got = np.array(t.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                got = b""
                for part, _ in t.pre_tokenizer.pre_tokenize_str(word.lower()) if not word.isalpha() else ((word.lower(), 0),):
                    known = parts.get(part)
                    if known is None:
                        known = older.get(part) or array("I", [x.id for x in model.tokenize(part)]).tobytes()
                        if len(part) <= PART_CHARS:
                            parts[part] = known
                    got += known
            size.append(len(got) // 4)
            ids.append(got)
        self.lists.add(np.array(size, np.int64), np.frombuffer(b"".join(ids), "<u4"))

    def __call__(self, w) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block in order, and how many each word has."""
        return self.lists(self.number(w))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    path = path or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ids = kept(("ids", path), lambda: _Ids(path))
        for b in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for lo, hi, text in blocks(b.column(1)):
                w = words(text)
                flat, n = ids(w)
                per_doc = np.bincount(w.doc, n, hi - lo).astype(np.int64)
                ends = np.cumsum(per_doc)
                for i in range(hi - lo):
                    doc = np.append(flat[ends[i] - per_doc[i] : ends[i]], np.uint32(0)).astype("<u4", copy=False)
                    for k, at in enumerate(range(0, len(doc), length)):
                        part = doc[at : at + length]
                        rows.append(lo + i)
                        piece.append(k)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: largest first, each into the fullest bin that still takes it."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: dict[int, list[int]] = {}
    rooms: list[int] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(rooms, s)
        if k == len(rooms):
            b, room = n, length
            n += 1
        else:
            room = rooms[k]
            b = open_[room].pop()
            if not open_[room]:
                rooms.pop(k)
        bin_of[i], offset[i] = b, length - room
        room -= s
        if room:
            if not open_.setdefault(room, []):
                bisect.insort(rooms, room)
            open_[room].append(b)
    return bin_of, offset


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """The best of the volume bound and two families of dual-feasible functions: u(k), which rounds to multiples of
    1/(k+1), and f(e), which takes items above length - e as whole and drops those below e."""
    return _bound(np.bincount(sizes, minlength=length + 1).astype(np.int64), length)


def _bound(count: np.ndarray, length: int) -> int:
    """The same from how many items have each size."""
    x = np.arange(length + 1)
    best = -(-int((count * x).sum()) // length)
    for k in range(1, 21):
        scaled = (k + 1) * x
        f = np.where(scaled % length == 0, x * k, (scaled // length) * length)
        best = max(best, -(-int((count * f).sum()) // (k * length)))
    many, total = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, length // 2 + 1):
        big, mid = int(many[length] - many[length - e]), int(total[length - e] - total[e - 1])
        best = max(best, big + -(-mid // length))
    return best


def pack(pieces: DataFrame, length: int = LENGTH, part_rows: int = 20_000, rounds: int = 3, spare: int = 2) -> DataFrame:
    """pieces (columns with a ``length``) with sequence_id and offset."""
    cols = pieces.columns
    full = pieces.where(F.col("length") == length)
    rest = staged(pieces.where(F.col("length") < length).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    sizes = rest.select("_row", F.col("length").alias("size"))
    done, todo = [], sizes
    for r in range(rounds):
        n = todo.count()
        if not n:
            break
        parts = max(1, -(-n // part_rows))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("_row", F.lit(r)), F.lit(parts)))
        packed = staged(dealt.groupBy("part").applyInArrow(_pack(length, spare, r == rounds - 1 or parts == 1), "_row long, size long, part long, bin long, off long, again boolean"), "packed")
        done.append(packed.where("NOT again").select("_row", F.lit(r).alias("round"), "part", "bin", "off"))
        todo = packed.where("again").select("_row", "size")
    seq = F.xxhash64(F.lit(0))
    if done:
        placed = done[0]
        for x in done[1:]:
            placed = placed.unionByName(x)
        #: partition and bin number in one long: rounds below 16, bins below 2**24 in a partition of part_rows
        seq = (F.col("part") * F.lit(1 << 28) + F.col("round") * F.lit(1 << 24) + F.col("bin")) * 2
        out = rest.join(placed.select("_row", seq.alias("sequence_id"), F.col("off").alias("offset")), "_row").select(*cols, "sequence_id", "offset")
    else:
        out = rest.select(*cols, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    alone = full.select(*cols, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(alone)


def certified(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, bound, gap. The bound is that of all pieces together; a gap of 0 means that no packing has fewer."""
    used = packed.agg(F.count_distinct("sequence_id").alias("sequences"))
    rows = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row a length
    count = np.zeros(length + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["n"]
    bound = F.lit(_bound(count, length)).cast("long")
    return used.select("sequences", bound.alias("bound"), (F.col("sequences") - bound).alias("gap"))


def _pack(length: int, spare: int, final: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sizes = rows["size"].to_numpy()
        bin_of, offset = best_fit_decreasing(sizes, length)
        n = int(bin_of.max()) + 1
        gap = n - lower_bound(sizes, length)
        again = np.zeros(len(rows), bool)
        if gap > 0 and not final:
            fill = np.bincount(bin_of, sizes, n)
            emptiest = np.zeros(n, bool)
            emptiest[np.argsort(fill, kind="stable")[: gap + spare]] = True
            again = emptiest[bin_of]
        part = np.full(len(sizes), key[0].as_py(), np.int64)
        return pa.table({"_row": rows["_row"], "size": pa.array(sizes), "part": pa.array(part), "bin": pa.array(bin_of), "off": pa.array(offset), "again": pa.array(again)})

    return run


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = staged(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-pieces")
    return pack(pieces)
