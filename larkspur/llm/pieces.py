"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut before each run of spaces; no piece of the vocabulary crosses such a cut, so each marked word is encoded
alone, once per worker. New words are sorted: neighbours share prefixes, as in a depth-first walk of their trie, and the
walk keeps the best scores of the current prefix and computes only those of the new characters.

A word's pieces are those of the highest summed model score; of equal ones, the last piece is the longest. A character
that is no piece becomes its UTF-8 bytes' pieces. The model's spaces are marked U+2581; that character itself is encoded
as bytes, so that decoding gives back every text. An empty text has no pieces; others get the leading mark.

Defined cases: a null text counts as empty; repeated rows each get their row; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import IdLists, WordRows, Words, blocks, kept, tidy

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.plain = {sp.id_to_piece(i).replace(MARK, " "): (sp.get_score(i), i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: Lengths of the pieces with the same last three characters, longest first, then 2 and 1.
        tails: dict[str, list[int]] = {}
        for piece in sorted(self.plain, key=len, reverse=True):
            if len(piece) > 2 and len(piece) not in tails.setdefault(piece[-3:], []):
                tails[piece[-3:]].append(len(piece))
        self.tails = {k: (*v, 2, 1) for k, v in tails.items()}
        self.unknown = min(s for s, _ in self.plain.values() if s > -1e8) - 10
        self.bytes_of = [b""] * n
        for piece, (_, i) in self.plain.items():
            self.bytes_of[i] = piece.encode()
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        self.lists = IdLists()
        self.number = WordRows(self.learn, self.lists.keep)

    def best(self, marked: list[str]) -> list[list[int]]:
        """Ids of each of the sorted words."""
        plain, tails, short, unknown = self.plain, self.tails, (2, 1), self.unknown
        score, back, before, out = [0.0], [None], "", []
        for word in marked:
            shared = len(commonprefix((before, word)))
            del score[shared + 1 :], back[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                top, how = -1e300, None
                for n in tails.get(word[j - 3 : j], short) if j > 2 else short:
                    if n <= j:
                        p = plain.get(word[j - n : j])
                        if p is not None and score[j - n] + p[0] > top:
                            top, how = score[j - n] + p[0], (j - n, p[1])
                if word[j - 1] not in plain and score[j - 1] + unknown > top:
                    top, how = score[j - 1] + unknown, (j - 1, -1)
                score.append(top)
                back.append(how)
            ids, j = [], len(word)
            while j:
                i, p = back[j]
                ids += [p] if p >= 0 else [self.byte[b] for b in reversed(word[i:j].encode())]
                j = i
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, new: list[str]) -> None:
        order = sorted(range(len(new)), key=new.__getitem__)
        found: list = [None] * len(new)
        for i, ids in zip(order, self.best([new[i] for i in order])):
            found[i] = ids
        self.lists.add(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def encode(self, text: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a block."""
        w = marked_words(text)
        flat, n = self.lists(self.number(w))
        return np.split(flat, np.cumsum(np.bincount(w.doc, n, len(text)).astype(np.int64))[:-1])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


def marked_words(text: pa.Array) -> Words:
    """Runs of spaces with the word behind them, of texts with the leading space added."""
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = buf == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(buf)) if len(start) else start
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=len(text))
    return Words(buf, offsets, start, end, doc, count, np.cumsum(count) - count)


def coder(path: str) -> PieceCoder:
    return kept(("pieces", path), lambda: PieceCoder(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids."""
    path = path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(path)
        for b in batches:
            for lo, hi, text in blocks(b.column(1)):
                ids = c.encode(text)
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    path = path or default_model()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256."""
    path = path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = coder(path)
        for b in batches:
            for lo, hi, text in blocks(b.column(1)):
                ids = c.encode(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(c.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidy(run), f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
