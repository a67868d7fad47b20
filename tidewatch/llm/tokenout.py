"""Token ids in length-delimited binary shards, with an offset index beside each.

Layout. A shard is a sequence of records, little-endian:
    uint64 length | uint32 masked checksum of those 8 bytes | data | uint32 masked checksum of data
where data is: int64 doc_id | uint8 1 if the doc_id is null | uint8 width | ids of ``width`` bytes each
(2 where the vocabulary fits, else 4). A checksum c is stored as
    ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, c being the CRC-32 of zlib.
The index of a shard holds the uint64 offset of each record, so that a reader can
visit records in any order. Documents stand in ascending doc_id order over the
shards of the manifest, which gives each shard's place and its ids before it.

Texts are range-partitioned by doc_id, and each partition is encoded and written as
one shard; a task writes under a name of its own attempt and the manifest names the
attempts that succeeded, so a retried or speculative task leaves no wrong shard.

Encoding goes through the tokenizers library. Texts are first cut where the
tokenizer cuts them for certain (ASCII white space, which it drops, and the border
between an ASCII letter or digit and an ASCII sign); pieces are looked up in a cache
and only new ones are encoded. Texts that hold a special token's string are encoded
whole. ``pieces_are_safe`` checks the vocabulary file for what this relies on; for
any other file every text is encoded whole.

Defined cases: a null or empty text has the end id alone; a null doc_id stands
first; rows that repeat a doc_id are written each, in order of a hash of their text; an empty
table gives an empty manifest and no rows; columns besides doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.words import BASE, INVERSE, blocks, mix, parts, powers, text_buffers

END_ID = 2
#: Pieces kept by a worker; the cache starts anew beyond it.
CACHE = 600_000
#: Shards whose ids are summed in a task.
SUMMED = 4096
#: Bytes of text that are looked up at a time: each time, new pieces are merged into the whole cache.
BLOCK = 1 << 20
#: Bytes of text in a shard, about.
SHARD_BYTES = 64 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SIGN = np.zeros(256, bool)
SIGN[33:127] = True
SIGN &= ~(ALPHA | DIGIT)
HIGH = np.zeros(256, bool)
HIGH[128:] = True
#: One class for each byte: 0 other, 1 letter, 2 digit, 3 sign, 4 apostrophe.
KIND = np.where(ALPHA, 1, np.where(DIGIT, 2, np.where(SIGN, 3, 0))).astype(np.uint8)
KIND[39] = 4
#: Whether a token always ends between two classes.
CUTS = np.zeros((5, 5), bool)
for _a, _b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2)):
    CUTS[_a, _b] = True
CUTS = CUTS.ravel()

#: Pieces that are one word to the tokenizer, besides letters.
ONE = re.compile(r"""[0-9]|[!-&(-/:-@\[-`{-~]+""")
#: The split pattern that CUTS is made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces_are_safe(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, lower-cases by character and splits by SPLIT."""
    norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return norm == ["NFC", "Replace", "Lowercase"] and bool(pre) and pre[0].get("type") == "Split" and pre[0]["pattern"].get("Regex") == SPLIT and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert")) and bool(spec["model"].get("end_of_word_suffix"))


class Encoder:
    """Encodes columns of text; one for each file and worker."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.safe = pieces_are_safe(spec)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: list[str]) -> list:
        """Ids of pieces; many go to the library as one text, told apart by the ends of words."""
        plain = [k for k, p in enumerate(pieces) if p.isalpha() or ONE.fullmatch(p)]  # each has one token end at least
        out: list = [None] * len(pieces)
        for lo in range(0, len(plain), 64):
            some = plain[lo : lo + 64]
            ids = np.asarray(self.whole([" ".join(pieces[k] for k in some)])[0], np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                for k, x in zip(some, np.split(ids, cut[:-1]), strict=True):
                    out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole([pieces[k] for k in rest]), strict=True):
            out[k] = np.asarray(ids, np.uint32)
        return out

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        ids = self.fresh(pieces)
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, *ids))
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = np.insert(self.keys, into, keys[order]), np.insert(self.at, into, at[order]), np.insert(self.size, into, size[order])

    def encode(self, column: pa.Array):
        """Ids of each text as arrays, block after block of rows."""
        offsets, data = text_buffers(column)
        for first, last in blocks(offsets, BLOCK):
            raw = data[offsets[first] : offsets[last]]
            body = raw.tobytes()
            if not self.safe or any(s in body for s in self.specials):
                at = offsets[first : last + 1] - offsets[first]
                for ids in self.whole([body[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]):
                    yield np.asarray(ids, np.uint32)
            elif last - first == 1 and len(raw) > BLOCK:  # parts of a long text end with white space, which parts tokens for certain
                each = [next(self.block(raw[a:b], np.array([0, b - a]))) for a, b in parts(raw, SPACE, BLOCK)]
                yield np.concatenate(each)
            else:
                yield from self.block(raw, offsets[first : last + 1] - offsets[first])

    def block(self, raw: np.ndarray, at: np.ndarray):
        if not len(raw):
            yield from (np.zeros(0, np.uint32) for _ in at[1:])
            return
        # a letter is lower-cased unless a character outside ASCII follows, which may combine with it
        follows = np.zeros(len(raw), bool)
        follows[:-1] = HIGH[raw[1:]]
        low = raw + np.where((raw >= 65) & (raw <= 90) & ~follows, 32, 0).astype(np.uint8)
        kind, inside = KIND[raw], ~SPACE[raw]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | CUTS[kind[:-1] * 5 + kind[1:]]
        rows = at[:-1][at[:-1] < len(raw)]
        begin[rows] = inside[rows]
        starts = np.flatnonzero(begin)
        # a piece ends where white space, another piece or another row begins
        stop = np.zeros(len(raw) + 1, bool)
        stop[-1] = True
        stop[:-1] = begin | ~inside
        stop[rows] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, starts, side="right")]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
        known, where, back = np.unique(keys, return_index=True, return_inverse=True)
        new = self.missing(known)
        if new.any():
            pieces = [bytes(low[starts[k] : ends[k]]).decode("utf-8", "replace") for k in where[new]]
            self.learn(known[new], pieces)
            if self.missing(known).any():  # the cache started anew
                rest = self.missing(known)
                self.learn(known[rest], [bytes(low[starts[k] : ends[k]]).decode("utf-8", "replace") for k in where[rest]])
        place = np.searchsorted(self.keys, known)
        size, from_ = self.size[place][back], self.at[place][back]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(from_ - (upto - size), size) + np.arange(total)]
        cut = np.concatenate(([0], upto))[np.searchsorted(starts, at)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield ids[a:b]

    def missing(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(place, len(self.keys) - 1)] != keys


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), data, masked(data).to_bytes(4, "little")))


def unframe(stream) -> bytes | None:
    """The next record's data; None at the end. A wrong length or checksum raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("damaged record length")
    size = int.from_bytes(head[:8], "little")
    data, check = stream.read(size), stream.read(4)
    if len(data) < size or len(check) < 4 or masked(data) != int.from_bytes(check, "little"):
        raise ValueError("damaged record")
    return data


def opened(url: str):
    """File system and path of a URL or of an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(url)


MANIFEST = "shard bigint, path string, docs bigint, ids bigint, bytes bigint"


def writer(folder: str, tokenizer: str, end_id: int):
    """Arrow function: rows (doc_id, text) of a partition, in order, to one shard; a row of MANIFEST."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder, shard = Encoder.of(tokenizer), context.partitionId()
        fs, base = opened(folder)
        name = f"shard-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        out, offsets, at, docs, total = None, [], 0, 0, 0
        kind = np.uint16 if encoder.width == 2 else np.uint32
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.bin", compression=None, buffer_size=1 << 20)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                record = frame(b"".join(((doc_id or 0).to_bytes(8, "little", signed=True), bytes((doc_id is None, encoder.width)), ids.astype(kind).tobytes(), end)))
                out.write(record)
                offsets.append(at)
                at += len(record)
                docs += 1
                total += len(ids) + 1
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as f:
                f.write(np.array(offsets, np.uint64).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "docs": [docs], "ids": [total], "bytes": [at]})

    return run


def write(scratch: common.Scratch, docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards below ``folder``; the manifest, with ``before``: the ids of all shards before.

    Running sums go by blocks of shards, so no task holds more than a block of them or one row for each block.
    """
    spark = scratch.spark
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(common.partitions(spark), -(-size // SHARD_BYTES))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    made = placed.mapInArrow(common.tidy(writer(folder, tokenizer, end_id)), MANIFEST)
    rows = scratch.write(made, "shards").withColumn("block", F.floor(F.col("shard") / SUMMED))
    upto = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks_before = rows.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", upto(Window.orderBy("block")).alias("from"))
    rows = rows.join(F.broadcast(blocks_before), "block").withColumn("before", F.col("from") + upto(Window.partitionBy("block").orderBy("shard")))
    return scratch.write(rows.select(*[c.split()[0] for c in MANIFEST.split(", ")], "before"), "manifest")


def reader(batches):
    """Arrow function: manifest rows (path, before) to (doc_id, start, n_tokens, ids_crc32, position, ids offset checks)."""
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, base = opened(path)
            with fs.open_input_stream(f"{base}.idx", compression=None) as f:
                index = np.frombuffer(f.read(), np.uint64)
            rows, at, start = [], 0, before
            with fs.open_input_stream(f"{base}.bin", compression=None, buffer_size=1 << 20) as f:
                while (data := unframe(f)) is not None:
                    if len(rows) >= len(index) or index[len(rows)] != at:
                        raise ValueError(f"index and records differ in {path}")
                    at += len(data) + 16
                    ids = np.frombuffer(data, np.uint16 if data[9] == 2 else np.uint32, offset=10).astype("<u4")
                    rows.append((None if data[8] else int.from_bytes(data[:8], "little", signed=True), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
            if len(rows) != len(index):
                raise ValueError(f"index and records differ in {path}")
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the shards: doc_id, start, n_tokens and ids_crc32, checksums and index confirmed."""
    few = manifest.select("path", "before")
    return few.repartition(max(1, manifest.count())).mapInArrow(common.tidy(reader), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def record_at(path: str, k: int) -> bytes:
    """Data of record ``k`` of a shard, found through its index: for shuffled reads."""
    fs, base = opened(path)
    with fs.open_input_file(f"{base}.idx") as f:
        f.seek(8 * k)
        at = int.from_bytes(f.read(8), "little")
    with fs.open_input_file(f"{base}.bin") as f:
        f.seek(at)
        return unframe(f)


def encode_to_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` in the shared folder and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = common.Scratch(spark, "tokens")
    return read(write(scratch, docs.select("doc_id", "text"), common.url(scratch.path("files")), str(tokenizer)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_files(spark, common.table(spark, sf_dir, "documents"))
