import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulon.llm import packing
from tabulon.llm.registry import tokenizer_file

TEXTS = ["", None, "a", "two  blanks\n\nand lines \t end ", " lead", "it's we'll\nnew-line <|endoftext|> x", "naïve Größe été 😀  odd space", "word " * 3000, "x" * 5000, "a", "same words again", "same words again", "1234 56,7 ... ###"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(t, text):
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, t, capacity):
    """Exact round trip: every id in one piece, offsets gapless, windows not over capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, text in enumerate(texts):
        ids, at = ids_of(t, text), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_seq


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encode = packing.Encoder(*tokenizer_file())
    for text in TEXTS:
        if text:
            assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids_of(tokenizer, text)[:-1])


@pytest.mark.parametrize("parts", [1, 3])
def test_pack_round_trip(spark, tokenizer, parts):
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, part string, win int, ids int").repartition(parts)
    by_seq = check(packing.pack(df, tokenizer_file(), 64, 4).collect(), TEXTS, tokenizer, 64)
    assert sum(sum(r.length for r in p) < 64 for p in by_seq.values()) <= 1


def test_many_partitions_meet_in_rounds(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    texts = [f"doc {i} " + "w " * (i % 37) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    by_seq = check(packing.pack(df, tokenizer_file(), 128, 3).collect(), texts, tokenizer, 128)
    assert sum(sum(r.length for r in p) < 128 for p in by_seq.values()) <= 1


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer_file()).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), tokenizer_file()).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 3] and all(r.doc_id is None for r in rows)


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "in<|endoftext|>side  a word", "at the end <|endoftext|>", "<|endoftext|> at the start", "<|endoftext", "| <|endoftext|>\n\n"]


def test_added_tokens_are_one_id_each(spark):
    from tabulon.llm.registry import added_tokens

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(*tokenizer_file(), added_tokens())
    texts = ADDED + [t for t in TEXTS if t]
    for text in texts:
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids_of(plain, text)[:-1]), text
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    check(packing.pack(df, tokenizer_file(), 64, 4, added=added_tokens()).collect(), texts, plain, 64)


def test_windows_against_a_plain_best_fit(spark, tokenizer):
    """One partition: best fit, fullest out and topping up at the end, in plain Python over lengths."""
    rng = __import__("random").Random(3)
    texts = ["w " * rng.choice([1, 5, 30, 60, 61, 62, 63, 64, 200]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    cap, most, windows, open_ = 64, 3, [], []

    def place(doc, start, n):
        while n >= cap:
            windows.append([(doc, start, cap)])
            start, n = start + cap, n - cap
        while n:
            fits = [w for w in open_ if cap - sum(x[2] for x in w) >= n]
            if fits:
                w = min(fits, key=lambda w: (cap - sum(x[2] for x in w), windows.index(w) if w in windows else 0))
            elif len(open_) < most:
                w = []
                open_.append(w)
            else:
                w = min(open_, key=lambda w: cap - sum(x[2] for x in w))
            put = min(n, cap - sum(x[2] for x in w))
            w.append((doc, start, put))
            start, n = start + put, n - put
            if sum(x[2] for x in w) == cap:
                open_.remove(w)
                windows.append(w)

    for d, t in enumerate(texts):
        place(d, 0, len(ids_of(tokenizer, t)))
    got = packing.pack(df, tokenizer_file(), cap, most).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.doc_id, r.start, r.length))
    mine = sorted(tuple(x[1:] for x in sorted(s)) for s in seqs.values())
    full = sorted(tuple(w) for w in windows)
    # what stays open at the end is merged into as few windows as it fills
    assert all(w in mine for w in full)
    left = sum(x[2] for w in open_ for x in w)
    assert len(mine) == len(full) + -(-left // cap)
