"""Token ids in a binary file format, written and read back by distributed tasks.

A shard is a run of blocks, each decodable on its own. A block holds whole documents (or, for a document longer than a block,
all of it) and maps token ids to ranks by their frequency in the block, most frequent first, so that most ranks fit one byte. Ranks
are coded in one to four bytes; the lengths are kept apart from them, two bits a rank, four ranks a control byte. Decoding
looks up each control byte in a table of 256 rows of four lengths, and gathers the bytes with numpy.

Block layout, little-endian: magic ``PTK1``; uint32 documents, ids, ranks, data bytes; uint32 lengths of the doc-id part; doc ids (int64, and a
byte a document that says whether it is null); uint32 ids in each document; uint32 token id of each rank; control bytes; data bytes.

Documents are dealt by ranges of doc_id (then a hash of the text, which only splits equal ids), tokenised in their order and written by the
task at hand, so one shuffle of the text is all there is. The manifest has a row for each block; the reader deals blocks, not files, to tasks.

Equal to encoding each whole text in one call: a text is cut into pieces only where the byte-level pre-tokenizer cuts whatever stands
around (see ``piece_starts``), and texts with the special token's opening stay whole. Pieces are found on the bytes of many
texts at a time and numbered by Arrow, so that each distinct one is looked up, or encoded, once; a worker's cache of them is bounded.

Defined results: a null text is empty (the end id only); a null doc_id comes first and stays null; among equal ids the text's hash gives the
order; an empty table gives no shards and no rows. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import batch, bounded_batches, filesystem, materialize, put_file, scratch, tidy

END_ID = 0
#: Ids in a block before it is closed.
BLOCK_IDS = 1 << 20
#: Distinct pieces that a worker keeps, and the longest one kept.
CACHE_PIECES = 500_000
CACHED_BYTES = 64
#: Bytes of text that are cut into pieces at a time (or one text), and pieces that are encoded at a time.
SLICE_BYTES = 4 << 20
_AT_ONCE = 256
_simple = re.compile(r"[ \n]?\S+").fullmatch
MAGIC = b"PTK1"
_HEAD = struct.Struct("<4s5I")

#: For each control byte the lengths of its four ranks.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks again: lengths by table, then a gather for each of the bytes that a rank may have."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A block of documents, each with its own array of ids."""
    return pack_block(doc_ids, np.fromiter(map(len, ids), "<u4", len(ids)), np.concatenate(ids) if ids else np.zeros(0, np.uint32))


def pack_block(doc_ids: list[int | None], counts: np.ndarray, flat: np.ndarray) -> bytes:
    """A block of documents that have counts[i] ids each, one after the other in flat."""
    freq = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
    table = np.argsort(-freq, kind="stable")[: np.count_nonzero(freq)].astype("<u4")
    rank = np.zeros(len(freq), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = encode_ranks(rank[flat] if len(flat) else flat.astype(np.uint32))
    names = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + bytes(i is None for i in doc_ids)
    return _HEAD.pack(MAGIC, len(doc_ids), len(flat), len(table), len(data), len(names)) + names + counts.astype("<u4").tobytes() + table.tobytes() + control + data


def decode_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, docs, count, ranks, size, names = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at).tolist()
    doc_ids = [None if null else i for i, null in zip(doc_ids, block[at + 8 * docs : at + names])]
    at += names
    counts = np.frombuffer(block, "<u4", docs, at)
    table = np.frombuffer(block, "<u4", ranks, at + 4 * docs)
    at += 4 * (docs + ranks)
    controls = -(-count // 4)
    got = decode_ranks(np.frombuffer(block, np.uint8, controls, at), np.frombuffer(block, np.uint8, size, at + controls), count)
    return doc_ids, np.split(table[got], np.cumsum(counts[:-1], dtype=np.int64)) if docs else []


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_SPACES = _bytes_in((9, 13), (28, 32))
_LETTERS = _bytes_in((65, 90), (97, 122))
#: ASCII that ends a run of letters.
_MARKS = _bytes_in((0, 8), (14, 27), (33, 64), (91, 96), (123, 127))
#: First bytes of the white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200F, U+2028 to U+202F, U+205F, U+3000.
_LEADS = _bytes_in((0xC2, 0xC2), (0xE1, 0xE3))


def _white(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to white space (or to a character near it in number)."""
    white = _SPACES[data]
    at = np.flatnonzero(_LEADS[data])
    at = at[at < len(data) - 1]
    if len(at):
        one, two = data[at], data[at + 1]
        three = data[np.minimum(at + 2, len(data) - 1)]
        short = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        long = ((one == 0xE1) & (two == 0x9A) & (three == 0x80)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))
        long |= (one == 0xE2) & (((two == 0x80) & ((three < 0x90) | (three >= 0xA8)) & (three < 0xB0)) | ((two == 0x81) & (three == 0x9F)))
        for k, which in ((0, short | long), (1, short | long), (2, long)):
            white[np.minimum(at[which] + k, len(data) - 1)] = True
    return white


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that stand one after the other in data, the first at starts[0] = 0; pieces lie within a text.

    A piece begins with a text, with a space or newline that has no white space beside it, and after an ASCII letter with an
    ASCII character that is none. The pre-tokenizer cuts at all of these, whatever comes before and after. Texts with
    the opening of the special token stay whole.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        white = _white(data)
        cut[1:] = ((data[1:] == 32) | (data[1:] == 10)) & ~white[:-1]
        cut[:-1] &= ~white[1:]
        cut[1:] |= _MARKS[data[1:]] & _LETTERS[data[:-1]]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(special):
            ends = np.append(starts[1:], n)
            for k in np.unique(np.searchsorted(starts, special, "right") - 1):
                cut[starts[k] : ends[k]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole-text encoding with a bounded cache of pieces in front of the tokenizer: each piece that a slice of the input holds is looked up once."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        #: The cache: pieces, where the ids of each begin and how many they are, the ids, and which pieces were met since the last clearing.
        self.keys = pa.array([], pa.binary())
        self.first, self.size, self.ids, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, bool)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id's token begins with a space (as byte-level tokens write it); the token of a newline on its own.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.newline = vocabulary["\u010a"]

    def _bytes(self, ids) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def _parts(self, ids: np.ndarray, first: np.ndarray, count: int, skip: int) -> list[bytes]:
        """ids cut where first says that a piece begins; skip: ids to leave out at each beginning."""
        if len(first) != count:
            raise ValueError("this tokenizer does not cut words at white space")
        width, data = self.width, ids.tobytes()
        edges = (first * width).tolist() + [len(data)]
        return [data[i + skip * width : j] for i, j in zip(edges, edges[1:])]

    def _solve(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as bytes. Those with white space only in front are encoded many at a time, in one text, which the pre-tokenizer cuts at it."""
        out: list[bytes] = [b""] * len(pieces)
        texts = [p.decode("utf-8", "replace") for p in pieces]
        spaced, lined, bare = [], [], []
        for i, t in enumerate(texts):
            if _simple(t):
                (spaced if t[0] == " " else lined if t[0] == "\n" else bare).append(i)
            else:
                out[i] = self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids)
        for at in range(0, len(spaced), _AT_ONCE):
            part = spaced[at : at + _AT_ONCE]
            ids = self._encode("".join([texts[i] for i in part]))
            for i, x in zip(part, self._parts(ids, np.flatnonzero(self.spaced[ids]), len(part), 0)):
                out[i] = x
        for group, lead, skip in ((lined, "", 0), (bare, "\n", 1)):
            for at in range(0, len(group), _AT_ONCE):
                part = group[at : at + _AT_ONCE]
                ids = self._encode("".join([lead + texts[i] for i in part]))
                for i, x in zip(part, self._parts(ids, np.flatnonzero(ids == self.newline), len(part), skip)):
                    out[i] = x
        return out

    def _clear(self) -> None:
        """Keep what was met lately, half of the room at most."""
        keep = np.flatnonzero(self.met)[-(CACHE_PIECES // 2) :]
        size = self.size[keep]
        ends = np.cumsum(size)
        source = np.repeat(self.first[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        self.keys, self.ids, self.first, self.size, self.met = self.keys.take(pa.array(keep)), self.ids[source], ends - size, size, np.zeros(len(keep), bool)

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces' ids: a pool of ids, and where those of each piece begin in it and how many they are."""
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        found = pc.index_in(pieces, value_set=self.keys)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at = found.drop_null().to_numpy()
        self.met[at] = True
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        first[known], size[known] = self.first[at], self.size[at]
        missing = pieces.filter(pa.array(~known))
        solved = self._solve(missing.to_pylist())
        sizes = np.fromiter(map(len, solved), np.int64, len(solved)) // self.width
        new = np.frombuffer(b"".join(solved), self.kind)
        starts = np.cumsum(sizes) - sizes
        pool = np.concatenate((self.ids, new))
        first[~known], size[~known] = len(self.ids) + starts, sizes
        short = np.diff(np.frombuffer(missing.buffers()[1], np.int32, len(missing) + 1, missing.offset * 4)) <= CACHED_BYTES if len(missing) else np.zeros(0, bool)
        self.keys = pa.concat_arrays([self.keys, missing.filter(pa.array(short))])
        self.first, self.size, self.met = np.append(self.first, first[~known][short]), np.append(self.size, sizes[short]), np.append(self.met, np.ones(int(short.sum()), bool))
        kept = pool if short.all() else np.concatenate((self.ids, new[np.repeat(short, sizes)]))
        if not short.all():
            self.first[len(self.first) - int(short.sum()) :] = len(self.ids) + np.cumsum(sizes[short]) - sizes[short]
        self.ids = kept
        return pool, first, size

    def encode_flat(self, data: np.ndarray, starts: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of data (those that begin at starts; an empty one begins where the next does), each followed by end, and their number for each text."""
        n, docs = len(data), len(starts)
        full = np.append(starts, n)
        begun = starts[np.diff(full) > 0]
        at = piece_starts(data, begun) if n else np.zeros(0, np.int64)
        cuts = pa.py_buffer(np.append(at, n).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        pool, first, sizes = self._look_up(pieces.dictionary)
        tail = np.frombuffer(end, self.kind)
        first, sizes, pool = np.append(first, len(pool)), np.append(sizes, len(tail)), np.concatenate((pool, tail))
        #: The pieces' numbers with that of ``end`` after each text's.
        last = np.searchsorted(at, full[1:]) + np.arange(docs)
        code = np.full(len(at) + docs, len(first) - 1, np.int32)
        own = np.ones(len(code), bool)
        own[last] = False
        code[own] = pieces.indices.to_numpy(zero_copy_only=False)
        size = sizes[code]
        ends = np.cumsum(size)
        source = np.repeat(first[code] - (ends - size), size)
        source += np.arange(len(source))
        return pool[source], np.diff(ends[last], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8") for t in texts]
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        flat, counts = self.encode_flat(np.frombuffer(b"".join(parts), np.uint8), ends - [len(x) for x in parts], b"")
        return np.split(flat, np.cumsum(counts)[:-1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the edges of its texts in them (a null is empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, edges, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(edges, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), edges


_encoders: dict[int, Encoder] = {}


def encoder(json: str) -> Encoder:
    """One in each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(json)
    return _encoders[key]


_MANIFEST = "shard int, block int, path string, at long, size long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the token ids of docs as shards below folder, in ascending doc_id order by shard, block and place; the manifest, a row a block."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.ptk"
        rows: list[tuple] = []

        def blocks():
            coder = encoder(sent.value)
            end = coder._bytes([end_id])
            names, counts, held, count, at = [], [], [], 0, 0

            def close():
                nonlocal names, counts, held, count, at
                block = pack_block(names, np.concatenate(counts), np.concatenate(held))
                rows.append((shard, len(rows), path, at, len(block), len(names), count))
                at += len(block)
                names, counts, held, count = [], [], [], 0
                return block

            for b in batches:
                ids, (data, edges) = b.column("doc_id").to_pylist(), text_bytes(b.column("text"))
                k = 0
                while k < len(ids):
                    j = max(k + 1, int(np.searchsorted(edges, edges[k] + SLICE_BYTES, "right")) - 1)
                    flat, sizes = coder.encode_flat(data[edges[k] : edges[j]], edges[k:j] - edges[k], end)
                    ends, i = np.cumsum(sizes), 0
                    while i < len(sizes):
                        before = ends[i] - sizes[i]
                        to = int(np.searchsorted(ends, before + block_ids - count, "right"))
                        if to <= i:
                            if count:
                                yield close()
                                continue
                            to = i + 1
                        names += ids[k + i : k + to]
                        counts.append(sizes[i:to])
                        held.append(flat[before : ends[to - 1]])
                        count += int(ends[to - 1] - before)
                        i = to
                    k = j
            if names:
                yield close()

        first = next(made := blocks(), None)
        if first is not None:
            put_file(path, (x for part in ((first,), made) for x in part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows))], schema=schema)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(dealt.mapInArrow(tidy(run), _MANIFEST), "manifest")


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32, ids (as little-endian uint32; null if with_ids is false) from the blocks of a manifest."""
    spark = manifest.sparkSession
    # Ids before a block: those of the shards before it (a row for each task that wrote) and of the blocks before it in its shard.
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select(F.col("shard").alias("of"), earlier(Window.orderBy("shard")).alias("first"))
    blocks = manifest.withColumn("inside", earlier(Window.partitionBy("shard").orderBy("block"))).join(F.broadcast(shards), F.col("shard") == F.col("of"))
    blocks = blocks.select("path", "at", "size", (F.col("first") + F.col("inside")).alias("start"))
    count = manifest.count()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for path, at, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "at", "size", "start"))):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    doc_ids, ids = decode_block(f.read(size))
                for k in range(0, len(ids), 256):
                    part = [x.astype("<u4").tobytes() for x in ids[k : k + 256]]
                    counts = np.array([len(x) // 4 for x in part])
                    ends = start + np.cumsum(counts)
                    yield batch(schema, doc_id=doc_ids[k : k + 256], start=pa.array(ends - counts, pa.int64()), n_tokens=pa.array(counts, pa.int64()), ids_crc32=[zlib.crc32(x) for x in part], ids=part if with_ids else [None] * len(part))
                    start = int(ends[-1])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    tasks = min(count, max(4 * spark.sparkContext.defaultParallelism, count // 32))
    return blocks.repartition(max(1, tasks)).mapInArrow(tidy(run), out)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write docs in the file format in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_shards(docs, tokenizer_path, scratch(docs.sparkSession, "tokens"), end_id, block_ids)
    return read_shards(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
