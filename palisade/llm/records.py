"""Token ids in framed binary records, with an offset index per file for shuffled reads.

A record is: length of the body (8 bytes, little-endian), masked CRC-32C of these bytes
(4), the body, masked CRC-32C of the body (4).  A body is: one byte 1 if there is an id,
the id (8, signed), then the ids as unsigned 16- or 32-bit integers.  ``*.rec`` files hold
records, the ``*.idx`` file beside each holds the byte offset of every record (8 each).

Cases: null text is empty and holds only the end id; rows without an id come first; rows
that repeat an id follow each other; an empty table writes no file and reads as empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import pieces, strings, written
from palisade.llm.words import IS_SPACE
from palisade.llm.words import words as word_places

SEGMENT = 1024
TEXT_BYTES = 2 << 20  # of text that a task takes apart into words at once
BODY_BYTES = 1 << 20  # of records that a task frames, or takes out of a file, at once
MANIFEST_ROWS = 500_000  # file starts are broadcast up to so many, beyond that joined
# Fixed values of the record format: the reflected CRC-32C polynomial and the mask of checksums.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of eight bytes at a time, and of a checksum after ``SEGMENT`` zero bytes."""
    table = np.zeros((8, 256), np.uint32)
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(POLYNOMIAL), row >> 1).astype(np.uint32)
    table[0] = row
    for k in range(1, 8):
        table[k] = (table[k - 1] >> 8) ^ row[table[k - 1] & 0xFF]
    shift = np.zeros((4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(SEGMENT):
            state = (state >> 8) ^ row[state & 0xFF]
        shift[k] = state
    return table, shift


@functools.cache
def _pair_tables() -> np.ndarray:
    """The tables of eight bytes, two bytes at a time."""
    table, both = _tables()[0], np.arange(1 << 16)
    return np.stack([table[7 - k][both & 0xFF] ^ table[6 - k][both >> 8] for k in (0, 2, 4, 6)])


def _raw(data: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC states after rows of equal length that is a multiple of eight."""
    table, parts = _pair_tables(), np.ascontiguousarray(data.view("<u2").T)
    for at in range(0, len(parts), 4):
        states = table[0][parts[at] ^ (states & 0xFFFF)] ^ table[1][parts[at + 1] ^ (states >> 16)] ^ table[2][parts[at + 2]] ^ table[3][parts[at + 3]]
    return states


def crc32c(bodies: list[bytes]) -> list[int]:
    """CRC-32C of each string: whole segments of all of them at once, then joined in order."""
    table, shift = _tables()
    one, shift = table[0].tolist(), shift.tolist()
    counts = [len(b) // SEGMENT for b in bodies]
    parts = b"".join(b[: n * SEGMENT] for b, n in zip(bodies, counts))
    zero = _raw(np.frombuffer(parts, np.uint8).reshape(-1, SEGMENT), np.zeros(sum(counts), np.uint32)).tolist() if parts else []
    out, at = [], 0
    # What is left of each string, eight bytes of all strings at once.
    states = []
    for body, n in zip(bodies, counts):
        state = 0xFFFFFFFF
        for k in range(at, at + n):
            state = shift[0][state & 0xFF] ^ shift[1][state >> 8 & 0xFF] ^ shift[2][state >> 16 & 0xFF] ^ shift[3][state >> 24] ^ zero[k]
        at += n
        states.append(state)
    rest = [len(b) - n * SEGMENT for b, n in zip(bodies, counts)]
    wide = np.array([r // 8 for r in rest], np.int64)
    order = np.argsort(-wide, kind="stable")
    state = np.array(states, np.uint32)[order]
    if len(bodies) and wide.max() > 0:
        block = np.zeros((len(bodies), int(wide.max()) * 8), np.uint8)
        for i, k in enumerate(order.tolist()):
            tail = bodies[k][counts[k] * SEGMENT : counts[k] * SEGMENT + int(wide[k]) * 8]
            block[i, : len(tail)] = np.frombuffer(tail, np.uint8)
        ordered = wide[order]
        for w in range(int(wide.max())):
            live = int(np.searchsorted(-ordered, -w, "left"))
            state[:live] = _raw(block[:live, w * 8 : w * 8 + 8], state[:live])
    back = np.empty(len(bodies), np.uint32)
    back[order] = state
    for body, s in zip(bodies, back.tolist()):
        for byte in body[len(body) - len(body) % 8 :] if len(body) % 8 else b"":
            s = (s >> 8) ^ one[(s ^ byte) & 0xFF]
        out.append(s ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(bodies: list[bytes]) -> list[bytes]:
    """Records of the bodies."""
    lengths = [len(b).to_bytes(8, "little") for b in bodies]
    sums = [masked(c).to_bytes(4, "little") for c in crc32c(lengths + bodies)]
    return [n + sums[i] + b + sums[len(bodies) + i] for i, (n, b) in enumerate(zip(lengths, bodies))]


def unframed(content: bytes | memoryview, most: int = BODY_BYTES) -> Iterator[list[bytes]]:
    """Bodies of a file's records, about ``most`` bytes at a time; an error names the place of a broken one."""
    at, done = 0, 0
    while at < len(content):
        begin, bodies, heads, want = at, [], [], []
        while at < len(content) and at - begin < most:
            head = bytes(content[at : at + 8])
            size = int.from_bytes(head, "little")
            if len(head) < 8 or at + 16 + size > len(content):
                raise ValueError(f"record at byte {at} is cut short")
            heads.append(head)
            bodies.append(bytes(content[at + 12 : at + 12 + size]))
            want.append((bytes(content[at + 8 : at + 12]), bytes(content[at + 12 + size : at + 16 + size])))
            at += 16 + size
        sums = [masked(c).to_bytes(4, "little") for c in crc32c(heads + bodies)]
        for i, (a, b) in enumerate(want):
            if a != sums[i] or b != sums[len(bodies) + i]:
                raise ValueError(f"record {done + i}: checksum differs")
        done += len(bodies)
        yield bodies


def unframe(content: bytes) -> list[bytes]:
    """Bodies of all records of a file."""
    return list(itertools.chain.from_iterable(unframed(content)))


# Fixed value: the pattern that cuts normalised words of the word-piece file before its merges.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# Characters that stay as they are but for lower-casing one by one: no marks, spaces or special cases.
PLAIN_LETTERS = np.zeros(0x181, bool)
PLAIN_LETTERS[[*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]] = True


def plain_pattern() -> str:
    """``PIECE`` or a space for lower-cased words of ``PLAIN_LETTERS``, its classes spelled out for ``re``."""
    import regex

    every = "".join(map(chr, np.flatnonzero(PLAIN_LETTERS).tolist()))
    letters, numbers = ("".join(regex.findall(kind, every)) for kind in (r"\p{L}", r"\p{N}"))
    return f"[{letters}]+| |'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^ {letters}{numbers}]+"


class Pieces:
    """Ids of strings that are encoded one by one, one after another in one array.

    ``gap`` stands between the strings of two rows; it has the number 0 and no ids.
    """

    def __init__(self, kind: np.dtype, gap: str | bytes):
        self.number: dict = {gap: 0}
        self.ids, self.starts, self.sizes, self.hits = np.zeros(1 << 16, kind), *np.zeros((3, 1 << 14), np.int64)
        self.used = 0

    def add(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.number), len(pieces)
        if at + n > len(self.starts):
            more = max(at + n, 2 * len(self.starts)) - len(self.starts)
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.starts, self.sizes, self.hits))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n], self.sizes[at : at + n], self.hits[at : at + n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(ids)
        self.number.update(zip(pieces, range(at, at + n)))

    def drop(self, pieces: list) -> None:
        """Forget the pieces that were added last."""
        for piece in pieces:
            del self.number[piece]
        self.used -= int(self.sizes[len(self.number) : len(self.number) + len(pieces)].sum())

    def shrink(self, most: int) -> None:
        """Keep at most so many pieces, the most used of those used more than once; earlier use counts half."""
        hits = self.hits[: len(self.number)].copy()
        hits[0] = 0
        keep = np.flatnonzero(hits > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-hits[keep], most)[:most]])
        gap, *every = self.number
        sizes = self.sizes[keep]
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[keep] - (np.cumsum(sizes) - sizes), sizes)]
        self.__init__(ids.dtype, gap)
        self.add([every[i - 1] for i in keep.tolist()], ids, sizes)
        self.hits[1 : len(keep) + 1] = hits[keep] // 2

    def find(self, cut: list) -> np.ndarray:
        """Number of each piece, -1 for those not met before."""
        return np.fromiter(map(self.number.get, cut, itertools.repeat(-1)), np.int64, len(cut))

    def spelled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows that numbers of pieces, with a gap after each row, spell, and each row's end."""
        self.hits[: len(self.number)] += np.bincount(at, minlength=len(self.number))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.ids[place], ends[at == 0]


class WordIds:
    """Packed ids of texts, word by word between white space, encoded by the tokenizers library.

    Its normaliser and pre-tokeniser never look across ASCII white space, so a text is its
    words in a row.  Where the file cuts words by ``PIECE``, a batch's new plain words are
    handled as one string: lower-cased, cut into pieces, and pieces not met before go to the
    library many at a time, told apart again by the mark of a word's end.  All other words go
    to it whole.  At most ``memory`` words are remembered, and as many pieces, beyond those of
    one batch; when they are full, the half met most often stays.  Words of more than
    ``longest`` bytes are forgotten after their batch.
    """

    def __init__(self, path: str, memory: int = 300_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memory, self.longest = Tokenizer.from_file(path), memory, longest
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = self.tokenizer.to_str()
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.by_piece = bool(suffix) and json.dumps(PIECE) in spec and json.loads(spec)["pre_tokenizer"]["pretokenizers"][-1] == BYTE_LEVEL
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_piece:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(plain_pattern()).findall
        # The same merges, held once, for pieces that are cut and lower-cased already.
        self.ready = self.tokenizer
        if self.by_piece:
            self.ready = Tokenizer(self.tokenizer.model)
            self.ready.add_tokens(list(self.tokenizer.get_added_tokens_decoder().values()))
            bytewise = pre_tokenizers.ByteLevel(**{k: v for k, v in BYTE_LEVEL.items() if k != "type"})
            self.ready.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        self.words, self.pieces = Pieces(self.kind, b" "), Pieces(self.kind, " ")

    def _whole(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            (ids,) = self._whole([" ".join(some)], self.ready)
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) == len(some) and edges[-1] == len(ids):
                self.pieces.add(some, ids, np.diff(edges, prepend=0))
            else:
                each = self._whole(some)
                self.pieces.add(some, np.concatenate(each), np.array([len(x) for x in each]))

    def _by_piece(self, words: list[bytes]) -> list[bytes]:
        """Plain words are learned by their pieces; returns the others."""
        joined = b" ".join(words).decode("utf-8", "replace")
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        gaps = letters == 0x20
        odd = np.zeros(len(words), bool)
        odd[np.cumsum(gaps)[~(gaps | PLAIN_LETTERS[np.minimum(letters, len(PLAIN_LETTERS) - 1)])]] = True
        texts = joined.split(" ")
        if any(a in joined for a in self.added):
            odd |= np.fromiter((any(a in t for a in self.added) for t in texts), bool, len(texts))
        even = (~odd).tolist()
        plain = list(itertools.compress(words, even))
        if plain:
            cut = self.cut(" ".join(itertools.compress(texts, even)).lower() + " ")
            wanted = set(cut)
            fresh = list(wanted.difference(self.pieces.number))
            if len(self.pieces.number) + len(fresh) > self.memory:
                self.pieces.shrink(self.memory // 2)
                fresh = list(wanted.difference(self.pieces.number))
            self._learn_pieces(fresh)
            ids, ends = self.pieces.spelled(self.pieces.find(cut))
            self.words.add(plain, ids, np.diff(ends, prepend=0))
        return list(itertools.compress(words, odd.tolist()))

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Add the words; returns the long ones, which come last."""
        long = [w for w in new if len(w) > self.longest]
        rest = [w for w in new if len(w) <= self.longest]
        if self.by_piece and rest:
            rest = self._by_piece(rest)
        rest += long
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            each = self._whole([w.decode("utf-8", "replace") for w in some])
            self.words.add(some, np.concatenate(each), np.array([len(x) for x in each]))
        return long

    def _packed(self, words: pa.Array, first: np.ndarray) -> list[bytes]:
        """Packed ids of rows of words; ``first`` has the place of each row's first word, and the end."""
        if len(first) < 2:
            return []
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self.words.find(distinct)
        missing, long = np.flatnonzero(at < 0), []
        if len(self.words.number) + len(missing) > self.memory:
            self.words.shrink(self.memory // 2)
            at = self.words.find(distinct)
            missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            long = self._learn(new)
            at[missing] = self.words.find(new)
        is_word = np.ones(len(words) + len(first) - 1, bool)
        is_word[first[1:] + np.arange(len(first) - 1)] = False
        rows = np.zeros(len(is_word), np.int64)
        rows[is_word] = at[coded.indices.to_numpy()]
        ids, ends = self.words.spelled(rows)
        self.words.drop(long)
        packed, edges = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *edges], edges)]

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Packed ids of each text, given as its words."""
        words = pa.array(itertools.chain.from_iterable(texts), pa.binary())
        return self._packed(words, np.cumsum([0, *map(len, texts)]))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text of a column; null is empty."""
        offsets, data = strings(texts)
        starts, ends, first = word_places(data, offsets)
        ends = np.cumsum(ends - starts, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        inner = pa.py_buffer(np.concatenate([np.zeros(1, ends.dtype), ends]))
        kind = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
        words = pa.Array.from_buffers(kind, len(ends), [None, inner, pa.py_buffer(data[~IS_SPACE[data]])])
        return self._packed(words, first)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself would take it: without one it is in the session's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(folder: str):
    """File system and path of a qualified folder, for use inside tasks."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else folder)


def _write(folder: str, path: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, context = word_ids(path), TaskContext.get()
        store, root = _filesystem(folder)
        part, attempt = context.partitionId(), context.taskAttemptId()
        end, files = np.array([end_id], coder.kind).tobytes(), []
        bodies, held, size, lengths, out = [], 0, 0, [], None  # not written yet and their bytes; of the open file

        def draft(kind: str) -> str:
            # A retried or second attempt writes the same bytes and takes the name over at once.
            return f"{root}/_{part:06d}-{len(files):05d}.{attempt}.{kind}"

        def put() -> None:
            nonlocal bodies, held, out
            out = out or store.open_output_stream(draft("rec"))
            records = frame(bodies)
            out.write(b"".join(records))
            lengths.extend(map(len, records))
            bodies, held = [], 0

        def close() -> None:
            nonlocal size, lengths, out
            if bodies:
                put()
            out.close()
            name = f"{part:06d}-{len(files):05d}"
            store.move(draft("rec"), f"{root}/{name}.rec")
            starts = np.cumsum([0, *lengths])[:-1].astype("<u8")
            with store.open_output_stream(draft("idx")) as index:
                index.write(starts.tobytes())
            store.move(draft("idx"), f"{root}/{name}.idx")
            files.append((name, len(lengths), sum(n - 25 for n in lengths) // coder.kind.itemsize))
            size, lengths, out = 0, [], None

        for batch in pieces(batches, 1, TEXT_BYTES):
            packed = coder.encode_column(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), packed):
                head = b"\x00" + bytes(8) if doc is None else b"\x01" + doc.to_bytes(8, "little", signed=True)
                bodies.append(head + ids + end)
                held += len(bodies[-1])
                size += len(bodies[-1])
                if size >= file_bytes:
                    close()
                elif held >= BODY_BYTES:
                    put()
        if size:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())],
            ["file", "n_records", "n_ids"],
        )

    return run


def write_records(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, file_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode the texts and write them to ``folder`` in ascending id order.

    Returns the manifest: file, n_records, n_ids and start, the ids before it.  Texts are
    range-partitioned by id, with the text's hash to part equal ids; file names are in range
    order.  Ids are added up per range part first, then inside each part.  ``folder`` is any
    path that all executors see.
    """
    folder = qualified(docs.sparkSession, folder)
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    ordered = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = written(ordered.mapInArrow(_write(folder, path, end_id, file_bytes), "file string, n_records long, n_ids long"), "files")
    files = files.withColumn("part", F.split("file", "-")[0])
    total, starts = 0, []
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each range part
        starts.append((row["part"], total))
        total += row["n"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, "part string, offset long"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, "part").select(
        "file", "n_records", "n_ids", (F.col("inside") + F.col("offset")).alias("start")
    )


def _parse(itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content, index, file in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                offsets = [0]
                for bodies in unframed(memoryview(content.as_buffer())):
                    offsets.extend((offsets[-1] + np.cumsum([len(b) + 16 for b in bodies])).tolist())
                    counts = np.array([(len(b) - 9) // itemsize for b in bodies], np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int.from_bytes(b[1:9], "little", signed=True) if b[0] else None for b in bodies], pa.int64()),
                        pa.array(start + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([np.frombuffer(b, f"<u{itemsize}", offset=9).astype("<u4").tobytes() for b in bodies], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "packed"])
                    start += int(counts.sum())
                if hashlib.sha256(np.array(offsets[:-1], "<u8").tobytes()).hexdigest() != index:
                    raise ValueError(f"{file}: its index differs from its records")

    return run


def id_bytes(path: str) -> int:
    """Bytes of one id in files written with this tokenizer."""
    return word_ids(path).kind.itemsize


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, itemsize: int = 2) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``packed`` (ids of 32 bits) of every record in the files.

    Files are of a bounded size and read whole, their records taken out part by part; every
    checksum is tested, and the places of the records against the file's index.
    """
    folder = qualified(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder).select("path", "content")
    files = files.withColumn("file", F.regexp_extract("path", r"([0-9-]+)\.rec$", 1))
    index = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder)
    index = index.select(F.regexp_extract("path", r"([0-9-]+)\.idx$", 1).alias("file"), F.sha2("content", 256).alias("index"))
    starts = manifest.select("file", "start").join(index, "file", "left")
    if manifest.limit(MANIFEST_ROWS + 1).count() <= MANIFEST_ROWS:  # a few dozen bytes each
        starts = F.broadcast(starts)
    placed = files.join(starts, "file").select("start", "content", "index", "file")
    return placed.mapInArrow(_parse(itemsize), "doc_id long, start long, n_tokens long, packed binary")


def read_shuffled(spark: SparkSession, folder: str, seed: int, itemsize: int = 2) -> DataFrame:
    """All records in an order drawn from ``seed``: the index is shuffled, bodies are read by offset.

    Returns ``place`` (the random key that orders the result), ``doc_id`` and ``packed``.
    """
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        opened: dict = {}
        for batch in batches:
            ids, packed = [], []
            for name, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                source = opened.get(name) or opened.setdefault(name, store.open_input_file(f"{root}/{name}.rec"))
                head = source.read_at(12, offset)
                size = int.from_bytes(head[:8], "little")
                (body,) = unframe(head + source.read_at(size + 4, offset + 12))
                ids.append(int.from_bytes(body[1:9], "little", signed=True) if body[0] else None)
                packed.append(np.frombuffer(body, f"<u{itemsize}", offset=9).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["place", "doc_id", "packed"])

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = np.frombuffer(content.as_py(), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at)], ["file", "offset"])

    index = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder)
    index = index.select(F.regexp_extract("path", r"([0-9-]+)\.idx$", 1).alias("file"), "content")
    index = index.mapInArrow(offsets, "file string, offset long")
    drawn = index.select(F.xxhash64(F.lit(seed), "file", "offset").alias("place"), "file", "offset")
    drawn = drawn.repartitionByRange("place", "file", "offset").sortWithinPartitions("place", "file", "offset")
    return drawn.mapInArrow(run, "place long, doc_id long, packed binary")
