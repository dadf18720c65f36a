"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Format. A dictionary table maps rank to token id, ranks ordered by descending
count over all documents (ties by id). Ranks are stored in blocks of about a
million: a *control* stream of one byte for four ranks, each giving a rank's
byte length minus one in two bits (first rank lowest), and a separate *data*
stream of the ranks' little-endian bytes without leading zeros. The last control
byte of a block is padded with zero-length-code slots that the stored count cuts
off. Blocks lie in ascending doc_id order; a block also holds its doc_ids and
the documents' token counts. Blocks and dictionary are Parquet tables in a
folder that every executor can read, so writing them is a Spark commit.

Decoding is table lookup: a 256 x 4 table gives the lengths behind each control
byte, their running sum the data positions, and four masked gathers the ranks.

Defined cases: a null or empty text is its end id alone; repeated rows are
encoded each; null doc_ids come first; rows of one doc_id lie in the order of a
hash of their ids; an empty table writes empty files.
Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, lean, materialize

#: Appended to each document.
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Ranks in a block, about.
BLOCK = 1 << 20
#: Bytes of chunks, and of the words in them, whose ids a worker remembers, about (a
#: bound on its memory only), and bytes of an entry besides its text and ids.
CHUNK_BYTES, WORD_BYTES, ENTRY_BYTES = 32 << 20, 64 << 20, 150

#: Bytes of text whose chunks are told apart together, about.
TEXT_BLOCK = 8 << 20

# chunks of printable ASCII and Latin-1 letters, and the tokenizer's words in them
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet for Latin-1 letters: a byte that is a visible
    Latin-1 character stands for itself, the others count up from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    symbol = {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SYMBOLS = _byte_symbols()
_loaded: dict[str, "ChunkEncoder"] = {}


class Memory(dict):
    """Ids by text, up to about ``most`` bytes: what comes later is not remembered,
    and frequent texts come early."""

    def __init__(self, most: int):
        self.left = most

    def put(self, text: str, ids: bytes) -> None:
        size = len(text) + len(ids) + ENTRY_BYTES
        if size <= self.left:
            self.left -= size
            self[text] = ids


class ChunkEncoder:
    """Ids of whole texts, white-space chunk by white-space chunk.

    The tokenizer drops white space and never merges across it, so a text's ids
    are its chunks' ids one after another. A block of texts is cut into chunks in
    numpy and dictionary-encoded in Arrow; distinct chunks are looked up or encoded
    once, and the block's ids are one gather. A chunk of printable ASCII and Latin-1
    letters goes word by word to the library's merge model, any other through the
    library's whole pipeline, and so does a whole text with white space outside
    ASCII or with a control character that only Python counts as white space.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.chunks = Memory(CHUNK_BYTES)
        self.parts = Memory(WORD_BYTES)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            symbols = part if part.isascii() else part.translate(_SYMBOLS)
            got = self._pack([t.id for t in self.model.tokenize(symbols)])
            self.parts.put(part, got)
        return got

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isascii() and low.isalpha():
            got = self._piece(low)
        elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            got = b"".join(map(self._piece, _WORDS.findall(low)))
        else:
            got = self._pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        self.chunks.put(chunk, got)
        return got

    def encode(self, text: str) -> bytes:
        raw, offsets = K.text_bytes(pa.array([text]))
        return self.block(raw, offsets)[0].tobytes()

    def block(self, raw: np.ndarray, offsets: np.ndarray, end: list[int] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
        """Ids of all texts one after another, ``end`` behind each, and the number
        before each text."""
        odd = np.unique(np.searchsorted(offsets, _odd_places(raw), "right") - 1)
        whole = np.zeros(len(offsets) - 1, bool)
        whole[odd] = True
        start, stop, first = K.words(raw, offsets, K.NOT_SPACE)
        words = np.concatenate([[0], np.cumsum(stop - start)])
        inside = raw[K.NOT_SPACE[raw]] if len(raw) else raw
        chunks = pa.StringArray.from_buffers(len(start), pa.py_buffer(words.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(inside)))
        coded = chunks.dictionary_encode()
        known, make = self.chunks, self._chunk
        blobs = [known.get(c) or make(c) for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        codes = coded.indices.to_numpy().astype(np.int64)
        if len(odd):
            keep = ~np.repeat(whole, np.diff(first))
            count = np.where(whole, 1, np.diff(first))
            texts = [raw[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd.tolist()]
            own = len(blobs) + np.arange(len(odd))
            blobs += [self._pack(self.whole.encode(t, add_special_tokens=False).ids) for t in texts]
            at = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(first)))])
            codes = np.insert(codes[keep], at[odd], own)
            first = np.concatenate([[0], np.cumsum(count)])
        if end:
            codes = np.insert(codes, first[1:], len(blobs))
            blobs.append(self._pack(end))
            first = first + np.arange(len(first))
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(blobs), self.kind)
        n = size[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        shift = (np.cumsum(size) - size)[codes] - before[:-1]
        return flat[np.repeat(shift, n) + np.arange(int(before[-1]))], before[first]


def _odd_places(raw: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII begins in UTF-8, or one of the four control
    characters that Python splits at and the tokenizer doesn't, stands."""
    found = [np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
    lead = np.flatnonzero(raw[:-1] >= 0xC2) if len(raw) else np.empty(0, np.int64)
    lead = lead[np.isin(raw[lead], [0xC2, 0xE1, 0xE2, 0xE3])]
    if len(lead):
        more = np.concatenate([raw, np.zeros(2, np.uint8)])
        two = more[lead].astype(np.int64) << 8 | more[lead + 1]
        three = two << 8 | more[lead + 2]
        found.append(lead[np.isin(two, _WIDE_SPACE) | np.isin(three, _WIDE_SPACE)])
    return np.sort(np.concatenate(found))


_WIDE_SPACE = [int.from_bytes(chr(c).encode()) for c in range(0x80, 0x3001) if chr(c).isspace()]


def tokenizer_path(name: str) -> str:
    """A file name is looked up among the public tokenizers, a path is itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id and its ids as little-endian unsigned 32-bit (16-bit where the
    vocabulary fits) integers, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, ChunkEncoder(tokenizer_path(tokenizer)))
        width = np.dtype(enc.kind).itemsize
        for b in batches:
            raw, offsets = K.text_bytes(b.column(1))
            for i, j in K.blocks(offsets, TEXT_BLOCK):
                ids, before = enc.block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [end_id])
                rows = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((before * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), rows], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encode), "doc_id long, ids binary")


def _width(tokenizer: str) -> type:
    from tokenizers import Tokenizer

    return np.uint16 if Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size() <= 1 << 16 else np.uint32


def rank_table(ids: DataFrame, width: type) -> DataFrame:
    """rank, token_id, n: ids by descending count over all documents."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                raw, _ = _binary(b.column(0).slice(at, 512))
                got = np.bincount(raw.view(width), minlength=len(total))
                got[: len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token_id", "n"])

    n = ids.select("ids").mapInArrow(lean(count), "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    return n.select((F.row_number().over(W.orderBy(F.desc("n"), "token_id")) - 1).alias("rank"), "token_id", "n")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.text_bytes(column)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    size = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = size
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= size[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: Byte lengths of the four ranks behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`encode_ranks`."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        if not len(more):
            break
        out[more] |= raw[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


FILES = "part int, seq int, n_docs int, n_ids long, doc_ids binary, lengths binary, control binary, data binary"


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Write the files; returns the block table read back and the dictionary
    (token ids by rank: at most one entry per vocabulary entry, so small)."""
    width = _width(tokenizer)
    ids = materialize(token_ids(docs, tokenizer, end_id), "token-ids")
    ranks = materialize(rank_table(ids, width), "token-ranks")
    listed = ranks.orderBy("rank").select("token_id").toArrow()
    by_rank = listed.column(0).to_numpy().astype(np.uint32)
    to_rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    to_rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    null = np.iinfo(np.int64).min
    shared = docs.sparkSession.sparkContext.broadcast(to_rank)

    def pack(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            doc_ids = np.concatenate([x for x, _, _ in held])
            lengths = np.concatenate([x for _, x, _ in held])
            control, data = encode_ranks(np.concatenate([x for _, _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(doc_ids), pa.int32()), (int(lengths.sum()), pa.int64()), (doc_ids.tobytes(), pa.binary()), (lengths.tobytes(), pa.binary()), (control, pa.binary()), (data, pa.binary()))], [f.split()[0] for f in FILES.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                raw, offsets = _binary(s.column(1))
                held.append((pc.fill_null(s.column(0), null).to_numpy(zero_copy_only=False).astype("<i8"), np.diff(offsets).astype("<i8") // np.dtype(width).itemsize, shared.value[raw.view(width)]))
                n += len(held[-1][2])
                if n >= BLOCK:
                    yield block()
                    held.clear()
                    n, seq = 0, seq + 1
        if held:
            yield block()

    # the second key spreads rows that share a doc_id, or have none, over partitions
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    placed = ids.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    files = materialize(placed.mapInArrow(lean(pack), FILES), "token-files", "none")
    discard(ids)
    return files, by_rank


def read_token_files(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(by_rank.astype("<u4"))
    null = np.iinfo(np.int64).min

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    starts = files.select("part", "seq", "n_ids").join(parts, "part").select("part", "seq", (F.col("part_start") + F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("block_start"))

    def unpack(batches):
        for b in batches:
            for row in range(b.num_rows):
                part, seq, _, n_ids, doc_ids, lengths, control, data = (b.column(i)[row].as_py() for i in range(8))
                doc_ids, lengths = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<i8")
                raw = memoryview(shared.value[decode_ranks(control, data, n_ids)].astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = np.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], np.int64)
                where = [pa.array(np.full(len(ends), v, np.int32)) for v in (part, seq)]
                yield pa.RecordBatch.from_arrays([*where, pa.array(doc_ids, pa.int64(), mask=doc_ids == null), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = files.mapInArrow(lean(unpack), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write every text's ids in the file format and read them back."""
    return read_token_files(*write_token_files(docs, tokenizer, end_id))
