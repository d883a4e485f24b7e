"""Token ids and token counts of whole texts with public tokenizers, in Arrow batches.

For counts, a text is cut where its tokenizer surely cuts it too: before white space that follows other characters. The units
between such cuts repeat over a corpus, so each worker encodes each distinct unit once and keeps it while it has room.

Counts of huge documents resynchronise overlapping chunks: see spliced().

Defined results: a null text counts as the empty text. Rows are never merged or dropped; repeated rows and null or repeated ids
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import ship, with_fields

#: White space beside blank, tab and line ends: texts with it are not cut.
EXOTIC = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
MIXED = re.compile(r"[ \n\t\r]{2}|[\t\r\x01]")
RUNS = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Units in a generation that a worker keeps, and the characters of the longest one kept.
KEPT, LONGEST = 350_000, 48
#: Rows and bytes of text handled at a time.
ROWS, CHARS = 2000, 4_000_000
#: What keeps a text from the ranks: other characters than these, whose classes no version of the libraries' Unicode tables disputes.
UNSURE = re.compile("[^\n\t\r\x20-\x7e\u00a1-\u024f]")
#: What keeps a text from being cut before its blanks: white space before one, or a blank at the end.
LOOSE = re.compile("[ \n\t\r] | \\Z")
#: Characters of text whose distinct words are encoded together.
WORDS = 8_000_000


def units(text: str) -> list[str]:
    """Pieces of a text whose encodings join to the text's; each starts with the white space before it."""
    if not MIXED.search(text) and not EXOTIC.search(text):
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
    return [text] if EXOTIC.search(text) else RUNS.findall(text)


class Encoder:
    """A tokenizer file, with the ids (little-endian 32-bit) of units kept in two generations: what is used moves to the young one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=1)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), 10_000):
            some = fresh[i : i + 10_000]
            for u, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.kept[u] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its units."""
        cut = [units(t) for t in texts]
        fresh = set().union(*cut).difference(self.kept)
        new = fresh.difference(self.older)
        for u in fresh.difference(new):
            self.kept[u] = self.older[u]
        if new:
            self._encode(sorted(new))
        out = [list(map(self.kept.__getitem__, c)) for c in cut]
        for u in new:
            if len(u) > LONGEST:
                del self.kept[u]
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        return out


class ByteEncoder:
    """Ids of a byte-level tokenizer file. Nothing is kept from batch to batch.

    ranks: the file's vocabulary for the other library, which has the same merges and is four times as fast. Texts with an added
    token's string or with UNSURE characters go to the file's own library."""

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(1 + max(merges.values()), np.int64)
        for token, rank in merges.items():
            self.sizes[rank] = len(token)

    def unsure(self, text: str) -> bool:
        return bool(UNSURE.search(text)) or any(a in text for a in self.added)

    def ids(self, text: str) -> np.ndarray:
        if self.unsure(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def rows(self, texts: pa.Array) -> pa.Array:
        """ids() of each text, as little-endian 16-bit numbers (binary).

        Texts are cut before their blanks, as the pattern does it, and a batch's distinct words are encoded once. Unsure and huge
        texts and those that can't be cut there are encoded whole."""
        whole = np.array([len(t) > WORDS or self.unsure(t) or bool(LOOSE.search(t)) for t in texts.to_pylist()], bool)
        apart = pa.array([self.ids(t).astype("<u2").tobytes() for t in texts.filter(pa.array(whole)).to_pylist()], pa.binary())
        if whole.all():
            return apart
        cut = pa.compute.split_pattern(pa.compute.replace_substring(texts.filter(pa.array(~whole)), " ", "\x01 "), "\x01")
        words = cut.flatten().dictionary_encode()
        flat, starts, sizes = self._words(words.dictionary)
        at = words.indices.to_numpy()
        each = sizes[at]
        ends = np.append(0, np.cumsum(each))
        places = np.repeat(starts[at] - ends[:-1], each)
        places += np.arange(len(places))
        offsets = 2 * ends[np.append(0, np.cumsum(cut.value_lengths().to_numpy()))]
        together = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat[places])])
        order = np.empty(len(whole), np.int64)
        order[np.argsort(whole, kind="stable")] = np.arange(len(whole))
        return pa.concat_arrays([together, apart]).take(pa.array(order)) if len(apart) else together

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' ids, and where each word's start and how many they are.

        Words with a blank in front are encoded as one text. Where all of them end with a token, no merge crosses from one to the next,
        and each has its own ids; else, and without a blank, they are encoded one by one."""
        spaced = pa.compute.starts_with(words, " ")
        row = words.filter(spaced)
        text = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), "")[0].as_py()
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        joined = spaced.to_numpy(zero_copy_only=False)
        reach, last = np.append(0, np.cumsum(self.sizes[ids])), np.cumsum(pa.compute.binary_length(row).to_numpy().astype(np.int64))
        upto = np.searchsorted(reach, last)
        if (reach[upto] != last).any():
            joined, ids, upto = np.zeros(len(words), bool), ids[:0], upto[:0]
        single = [self.fast.encode_to_numpy(w, disallowed_special=()) for w in words.filter(pa.array(~joined)).to_pylist()]
        sizes = np.empty(len(words), np.int64)
        sizes[joined], sizes[~joined] = np.diff(upto, prepend=0), [len(x) for x in single]
        order = np.argsort(~joined, kind="stable")
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, *single]).astype("<u2"), starts, sizes


_ENCODERS: dict[str, Encoder] = {}
_BYTE_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def byte_encoder(path: str, ranks: str) -> ByteEncoder:
    if path not in _BYTE_ENCODERS:
        _BYTE_ENCODERS[path] = ByteEncoder(path, ranks)
    return _BYTE_ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = ROWS, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and characters."""
    for b in batches:
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)), np.int64, b.num_rows) if b.nbytes > chars else np.zeros(b.num_rows, np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (i - start >= rows or total + n > chars):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)


def pieces(documents: DataFrame, path: str, ranks: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Rows of documents without text, for each piece of at most size tokens, with piece, start, length, ids_crc32 and ids (binary, if asked for).

    A document's tokens end with end_id. Only longer ones are cut; all pieces but the first are full."""
    ship(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in ("text", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")]
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = with_fields(rows.drop("text"), "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(path, ranks)
        for b in slices(batches, "text"):
            parts = [enc.ids(t.as_py()) for t in b.column("text")]
            n = np.array([len(p) + 1 for p in parts], np.int64)
            each = -(-n // size)
            at = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            first = (n - (each - 1) * size)[at]
            start = np.where(piece == 0, 0, first + (piece - 1) * size)
            length = np.where(piece == 0, first, size)
            raw = np.concatenate([x for p in parts for x in (p, end)]).astype("<u4").tobytes()
            cuts = 4 * np.append(0, np.cumsum(length))
            view = memoryview(raw)
            crc = [zlib.crc32(view[a:z]) for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            columns = [*b.drop_columns(["text"]).take(pa.array(at)).columns, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*b.drop_columns(["text"]).schema, *zip(names, (c.type for c in columns[-len(names) :]), strict=True)]))

    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return rows.mapInArrow(run, schema)


def _common(left: list[tuple], right: list[tuple], after: int) -> tuple[int, int] | None:
    """Places in both lists of one boundary between equal neighbours, the most central one of the shared stretch."""
    pairs = {(a, b): i + 1 for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if i + 1 > after and a[2] <= b[1]}
    found = [(pairs[a, b], j + 1, b[1]) for j, (a, b) in enumerate(zip(right, right[1:], strict=False)) if (a, b) in pairs]
    if not found:
        return None
    middle = (right[0][1] + left[-1][2]) / 2
    i, j, _ = min(found, key=lambda f: abs(f[2] - middle))
    return i, j


def spliced(enc: Encoder, text: str, size: int, overlap: int) -> list[int]:
    """Ids of a whole text from overlapping chunks.

    Neighbouring chunks are joined at a boundary where both have the same token before and the same token after it, with the
    same offsets. All neighbouring tokens of the joined row then stand as in one chunk's encoding, and byte pair merges make a row
    of tokens an encoding if each pair of neighbours is one. Where an overlap has no such boundary it is widened: to the left
    up to what has been kept, then by encoding from there to the end of the next chunk. An overlap holds any special token, so
    that one of the two chunks has it whole."""

    def tokens(a: int, z: int) -> list[tuple]:
        e = enc.tokenizer.encode(text[a:z], add_special_tokens=False)
        return [(i, s + a, t + a) for i, (s, t) in zip(e.ids, e.offsets, strict=True)]

    out: list[int] = []
    n, begin, end = len(text), 0, min(size, len(text))  # begin: where the current chunk starts
    current, used = tokens(begin, end), 0  # used: its tokens before this are in out, or another chunk's
    while end < n:
        wide, stop = max(overlap, enc.special), min(n, end + size)
        while True:
            start = max(begin, end - wide)
            following = tokens(start, stop)
            if start == begin:  # the whole of the current chunk is in it
                joint = (used, used) if following[:used] == current[:used] else None
                if joint is None and used and (joint := _common(current[: used + 1], following, used - 1)) is None:
                    begin, following = 0, tokens(0, stop)  # nothing kept can be proven: once more from the start
                    out, joint, used = [], (0, 0), 0
                joint = joint or (0, 0)
                break
            if joint := _common(current, following, used):
                break
            wide *= 2
        out += [t[0] for t in current[used : joint[0]]]
        begin, end, current, used = start, stop, following, joint[1]
    return out + [t[0] for t in current[used:]]


def counts(documents: DataFrame, path: str, chunk: int = 32_768, overlap: int = 1024) -> DataFrame:
    """Rows of documents without text, with n_bytes and n_tokens. Texts of more than chunk code points are encoded in overlapping chunks."""
    ship(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in ("text", "n_bytes", "n_tokens")]
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = with_fields(rows.drop("text"), "n_bytes long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            n = np.zeros(len(texts), np.int64)
            n[short] = [sum(map(len, parts)) // 4 for parts in enc.encode([texts[i] for i in short])]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = len(spliced(enc, t, chunk, overlap))
            sizes = pa.compute.binary_length(b.column("text").cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, sizes, pa.array(n)], names=[*keep, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counts(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)
