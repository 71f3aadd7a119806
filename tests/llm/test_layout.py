import zlib
from collections import defaultdict

import numpy as np
import pytest

from issuelens.llm.packing import CAPACITY, Encoder, pack, piece_lengths, tokenizer_path
from issuelens.llm.sharding import shard

from .conftest import prose


def laws(rows, shards):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.grown_shard is None and r.law == "bytes"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_shards_are_nearly_equal(spark, rng):
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(6000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    size = laws(out, 24)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    texts = dict(rows)
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_copies_stay_together_unless_too_many(spark, rng):
    texts = [prose(rng, 30) for _ in range(900)]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)] + [(10_000 + i, "hot " * 40) for i in range(1300)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    size = laws(out, 8)
    mean = sum(size.values()) / 8
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    split = [c for c, s in where.items() if len(s) > 1]
    assert len(where[zlib.crc32(b"hot " * 40)]) >= 2 and len(split) < 20


def test_shards_of_odd_rows(odd_docs, no_docs, odd_rows):
    rows = shard(odd_docs).collect()
    laws(rows, 24)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    assert shard(no_docs).count() == 0


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(reference_ids):
    encode = Encoder(tokenizer_path())
    odd = ["", "a  b\n c\t\td  ", "it's 'tis  he'll", "<|endoftext|> x", "é ß 中文 字 ١٢ ² ½ \U0001F600", "\x1c \x85 a　b", " \n\n x \n", "x" * 3000]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids(text)


@pytest.fixture(scope="module")
def default_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


SPECIAL = [
    "foo <|endoftext|> bar", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b\n", "x<|endoftext|>y <|endoftext", "<|ENDOFTEXT|> <|endoftext|",
    "é<|endoftext|>ß \n <|endoftext|>\n\n", "it<|endoftext|>'s", "none here",
]


def test_added_tokens_equal_the_library_at_its_defaults(default_ids, rng):
    assert default_ids(SPECIAL[0]) == [21943, 220, 50256, 2318]
    encode = Encoder(tokenizer_path(), special=True)
    parts = ["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "endoftext", "don't", "é", "中文", "42", "word", " end", "\u3000"]
    for text in [*SPECIAL, *("".join(rng.choices(parts, k=rng.randrange(1, 20))) for _ in range(2000))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == default_ids(text)


def test_packed_documents_hold_added_tokens(spark, default_ids):
    texts = dict(enumerate([*SPECIAL, "foo <|endoftext|> bar " * 900]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    checked(pack(docs, with_ids=True).collect(), texts, default_ids)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n ", "\u3000"])
def test_long_blanks_equal_the_library(default_ids, blank):
    encode = Encoder(tokenizer_path(), special=True)
    for text in (blank * (1_000_000 // len(blank)), "a" + blank * 19_990 + "b", "a <|endoftext|>" + blank * 30_000 + "word  x" + blank * 400_000 + "end"):
        assert np.frombuffer(encode(text), "<u4").tolist() == default_ids(text)


def test_long_blanks_are_packed(spark, default_ids):
    texts = {1: " " * 1_000_000, 2: "\n" * 500_000 + "x", 3: "a b"}
    checked(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts, default_ids)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Encoder(tokenizer_path("word_bpe_49k.json"))


def test_piece_lengths():
    for n in range(0, 5000, 7):
        lengths = piece_lengths(n)
        assert sum(lengths) == n and all(0 < x <= CAPACITY for x in lengths)
        assert all(CAPACITY - (CAPACITY // x) * x < CAPACITY // 16 for x in lengths)


def checked(rows, texts, ids_of):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        at = 0
        for r in b:
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    for i, text in texts.items():
        whole, at = [*ids_of(text), 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            mine = whole[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(mine, "<u4").tobytes())
            if "ids" in r.__fields__:
                assert r.ids == mine
            at += r.length
        assert at == len(whole)
    return bins


def test_packing_round_trip(spark, rng, reference_ids):
    texts = {i: prose(rng, rng.choice([0, 1, 5, 80, 400, 1500])) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    bins = checked(pack(docs, with_ids=True).collect(), texts, reference_ids)
    used = sum(r.length for b in bins.values() for r in b)
    assert len(bins) * CAPACITY < 1.03 * used


def test_packing_of_odd_rows(odd_docs, no_docs, odd_rows, reference_ids):
    rows = pack(odd_docs).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.length
    want = defaultdict(int)
    for i, t in odd_rows:
        want[i] += len(reference_ids(t)) + 1
    assert by == want
    assert pack(no_docs).count() == 0


def test_tidy_tasks_pass_all_batches_through():
    from issuelens.llm.staging import tidy

    def run(batches):
        for b in batches:
            yield 2 * b

    assert list(tidy(run)(iter([1, 2, 3]))) == [2, 4, 6] and list(tidy(run)(iter([]))) == []


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from issuelens.llm import wordhash

    texts = ["one two three", None, "", "Straße " * 500, "two three four", " \t"]
    whole = [h.tolist() for h in wordhash.word_hashes(texts)]
    monkeypatch.setattr(wordhash, "HASHED_BYTES", 8)
    assert [h.tolist() for h in wordhash.word_hashes(texts)] == whole
    assert whole[0][1:] == whole[4][:2] and whole[1] == whole[2] == whole[5] == []
