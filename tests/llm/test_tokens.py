"""Token ids, counts and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from cargolens.llm import packing, tokens
from tokenizers import Tokenizer

from tests.llm import data

BYTES, RANKS, WORDS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_op2_op7_units_encode_as_whole_texts(path):
    lib, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", "　", "\x85", "a", "don't", "'s", "''", "!!", "12", "é", "é", "́", "😀", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "漢字", "\x01", "​", "x" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)] + [r[1] or "" for r in data.rows()]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(b"".join(got), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)[:200]


def test_op2_ranks_give_the_ids_of_the_file():
    lib, enc = Tokenizer.from_file(BYTES), tokens.ByteEncoder(BYTES, RANKS)
    rng = random.Random(15)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "\u3000", "a", "don't", "'S", "''", "!!", "12", "é", "e\u0301", "😀", "<|endoftext|>", "<|start", "İ", "ß", "ĳ", "ª", "²", "½", "\xad", "¿", "漢字", "\x01", "\x7f", "x" * 60]
    safe = [p for p in parts if not tokens.UNSURE.search(p)]
    texts = ["".join(rng.choices(rng.choice([parts, safe]), k=rng.randint(1, 14))) for _ in range(6000)] + [r[1] or "" for r in data.rows()]
    texts += ["".join(rng.choices("abcdefghij", k=100_000)), " " * 50_000, "\n \n" * 20_000 + "x"] + [chr(c) * 3 + " " + chr(c) for c in range(0x250)]
    for t in texts:
        assert enc.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)[:200]
    assert sum(not tokens.UNSURE.search(t) for t in texts) > 2000


def test_op4_rows_of_distinct_words(monkeypatch):
    """Batches give each text's own ids; words that repeat are encoded once."""
    lib, enc = Tokenizer.from_file(BYTES), tokens.ByteEncoder(BYTES, RANKS)
    rng = random.Random(16)
    parts = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "a", "don't", "'s", "''", "!!", "12", "é", "ß", "\xa0", "\x01", "\x1c", "😀", "漢字", "<|endoftext|>", "x" * 60]
    plain = [" ", " a", " the", " of", " don't", "'s", ".", ",\n", "\n\n", " 12", " é", " ,", "B"]
    texts = ["".join(rng.choices(rng.choice([parts, plain, plain]), k=rng.randint(0, 14))) for _ in range(6000)] + [r[1] or "" for r in data.rows()]
    texts += ["x\n", " \nbar", "x\n \nbar", "\n", " ", "  ", " a", "", "a\n\n", " \n\nb", " \t", " \n\n\nb"]
    monkeypatch.setattr(tokens, "WORDS", 30_000)
    rng.shuffle(texts)
    at = 0
    while at < len(texts):
        some = texts[at : at + rng.randint(1, 300)]
        got = [np.frombuffer(x, "<u2").tolist() for x in enc.rows(pa.array(["before", *some, "after"], pa.string()).slice(1, len(some))).to_pylist()]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in some]
        at += len(some)
    assert sum(not enc.unsure(t) and not tokens.LOOSE.search(t) for t in texts) > 2000
    assert enc.rows(pa.array([], pa.string())).to_pylist() == []
    some, seen, fast = ["Some words and some more words of one kind.\nAnd more of one kind."] * 500, [], enc.fast
    monkeypatch.setattr(enc, "fast", type("Counting", (), {"encode_to_numpy": staticmethod(lambda t, **k: (seen.append(len(t)), fast.encode_to_numpy(t, **k))[1])}))
    assert len(set(enc.rows(pa.array(some)).to_pylist())) == 1 and sum(seen) < 100


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_op7_splices_as_whole_texts(path):
    lib, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(6)
    words = [" the", " of", "\n", "ing", "x", "'", "'s", "!", "é", "😀", "é", "<|endoftext|>", " ", "zz", "12"]
    for k in range(400):
        few = rng.sample(words, rng.randint(1, 6))
        t = "".join(rng.choices(few, k=rng.randint(20, 300)))
        assert tokens.spliced(enc, t, rng.choice([16, 40, 90]), rng.choice([1, 4, 12])) == lib.encode(t, add_special_tokens=False).ids, (k, t[:80])


def test_op7_counts(spark):
    lib = Tokenizer.from_file(WORDS)
    got = tokens.counts(data.documents(spark), WORDS, chunk=3000, overlap=64).collect()
    assert data.bag((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == data.bag((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in data.rows())
    assert tokens.counts(data.empty(spark), WORDS).count() == 0


def slow_plan(histogram, size):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(size - length)
    return len(rooms)


def test_op2_plan_is_best_fit():
    rng = random.Random(1)
    for _ in range(400):
        size = rng.choice([5, 10, 32, 64])
        histogram = {rng.randint(1, size): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        sequences, seen = {}, Counter()
        for length, first, upto, sequence, each, offset in packing.plan(histogram, size):
            for r in range(upto - first):
                sequences.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
                seen[length] += 1
        assert seen == histogram and len(sequences) == slow_plan(histogram, size)
        check_gapless(sequences, size)


def check_gapless(sequences, size):
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= size


def test_op2_packs_everything(spark):
    lib = Tokenizer.from_file(BYTES)
    got = packing.packed(data.documents(spark)).collect()
    want = []
    for r in data.rows():
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((r[0], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert data.bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == data.bag(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    check_gapless(sequences, 1024)
    assert len(sequences) == slow_plan(Counter(w[3] for w in want), 1024)
    assert packing.packed(data.empty(spark)).count() == 0


def test_op2_keeps_columns_of_any_name(spark):
    names = ["first", "upto", "sequence", "each", "rank", "within", "base", "salt", "item", "order", "offset", "length"]
    docs = spark.createDataFrame([(i, "a b c" * i, *range(len(names))) for i in range(20)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = packing.packed(docs, with_ids=True)
    assert got.columns == ["doc_id", *names[:-2], "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == 20 and all(r.first == 0 and r.order == 9 and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
