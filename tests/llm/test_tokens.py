"""Encoding, token records, packing and token counts, against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm.encoding import _WHOLE, MemoEncoder
from siltstone.llm.packing import best_fit, local_search, pack
from siltstone.llm.queries import BYTE_BPE as BYTE
from siltstone.llm.queries import WORD_BPE as WORD
from siltstone.llm.token_counts import token_counts
from siltstone.llm.token_records import deserialize, fetch_records, frame as framed, read_frame, read_token_records, serialize, write_token_records
from tests.llm.cases import ODD, clashing, empty, rows_of, sample

TRICKY = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", ".", ",", " .", "a.", "a .", "a. b", "a.b", "a..b", "...", "a, b,c ,d",
    "don't we'll I'M 'S 's", "x's y 's", "3.14 1,000,000 v2.0.1", "e.g., i.e.", "!.", "!,a", "a!.b", "_._", "\t.\t", "tab\tbed", "a\r\nb", "nbsp x", " wide", "é.è",
    "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>.", "x<|y", "<|", "|>", "İstanbul ǅ ß ẞ ΑΣ ΑΣ. ΑΣ a", "日本語。テキスト.", "😀.😀", "á.b́", "½.½", "²,²", "Ⅷ.", "a\x00b", "\x00", " \x00", "\x00 .",
    "İ.", "A \x00", "a \x00b c", "x İ. y", "MIXED Case, Words.", "http://a.b/c?d=e,f", "a" * 5000, ". " * 300, "\n" * 300, " " * 300, "ab " * 3000, "​.​", "ﬁ ﬂ", "﻿.x", "٣.٤", "a b", "a\x1cb", "a\x85b",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(spark, path):
    lib, own = Tokenizer.from_file(path), MemoEncoder(path)
    texts = TRICKY + [r.text or "" for r in sample(spark).select("text").collect()]
    for _ in range(2):  # with nothing and with everything in the memo
        for text, ids, n in zip(texts, own.encode(texts), own.count(texts), strict=True):
            want = lib.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want, text[:80]
            assert n == len(want)


def test_encoder_random_texts():
    rng = np.random.default_rng(5)
    alphabet = list("ab .,\n'sA1!_é") + ["<|endoftext|>", "\t", "Σ", "ς", " ", "I", "̇"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(4000)]
    for path in (BYTE, WORD):
        lib, own = Tokenizer.from_file(path), MemoEncoder(path)
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_character(path):
    """Each code point around stops, commas, blanks and letters: by pieces where the text is plain, else it goes whole."""
    lib, own = Tokenizer.from_file(path), MemoEncoder(path)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not _WHOLE.search(chr(c))]
    assert len(plain) == 203 and not set(plain) & {"\0", "\t", "\r", "\x85", "\xa0", "\xad", "\u0130"}
    forms = ["{0}.", "{0},", " {0}", "{0} ", ".{0}", "a{0}", "{0}a", "1{0}.", "a {0}.b", ",{0},", "{0}{0}", "{0}\n{0}", "\n{0}.", "'{0}", "{0}'s a"]
    texts = [f.format(c) for c in plain for f in forms] + [a + b for a in plain for b in plain]
    for text, ids, e in zip(texts, own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, repr(text)


def test_random_plain_and_odd_characters():
    rng = np.random.default_rng(9)
    alphabet = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000] + list("ab .,\n'") * 600
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 12))) for _ in range(8_000)]
    for path in (BYTE, WORD):
        lib, own = Tokenizer.from_file(path), MemoEncoder(path)
        for text, ids, e in zip(texts, own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids, repr(text)


def test_memo_is_bounded():
    own = MemoEncoder(BYTE, max_pieces=10)
    lib = Tokenizer.from_file(BYTE)
    for k in range(5):
        text = " ".join(f"w{k}x{i}" for i in range(20))
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def expected_ids(rows, path, end_id):
    lib = Tokenizer.from_file(path)
    return [(i, np.append(lib.encode(t or "", add_special_tokens=False).ids, end_id).astype("<u4")) for i, t in rows]


def test_records_round_trip(spark, tmp_path):
    docs = sample(spark).select("doc_id", "text").repartition(7)
    folder = f"file://{tmp_path}/rec"
    write_token_records(docs, folder, BYTE, end_id=2)
    want, start = [], 0
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    ids_of = dict(expected_ids(rows, BYTE, 2))
    for doc_id, ids in ids_of.items():
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(read_token_records(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want
    index = spark.read.parquet(f"{folder}/index").orderBy("offset").limit(20).collect()
    for r, ids in zip(index, fetch_records(folder, [(r.file, r.offset, r.n_bytes) for r in index]), strict=True):
        assert ids.tolist() == ids_of[r.doc_id].tolist()


def test_records_of_odd_rows(spark, tmp_path):
    for k, docs in enumerate((clashing(spark), empty(spark))):
        folder = f"file://{tmp_path}/rec{k}"
        write_token_records(docs, folder, BYTE, end_id=2)
        got = read_token_records(spark, folder)
        want = ODD if k == 0 else []
        assert sorted(r[1] for r in rows_of(got, "doc_id", "n_tokens")) == sorted(len(ids) for _, ids in expected_ids(want, BYTE, 2))


def test_damage_is_found():
    import io

    ids = np.array([1, 70_000, 2], np.uint32)
    data = framed(serialize(5, ids))
    doc_id, back = deserialize(read_frame(io.BytesIO(data)))
    assert (doc_id, back.tolist()) == (5, ids.tolist())
    assert deserialize(serialize(None, ids[:1]))[0] is None
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            read_frame(io.BytesIO(bytes(bad)))


def check_packing(got, rows, size, end_id=1):
    want = defaultdict(list)
    for i, ids in expected_ids(rows, WORD, end_id):
        want[i].append([(k, at, len(own := ids[at : at + size]), zlib.crc32(own.tobytes())) for k, at in enumerate(range(0, len(ids), size))])
    found = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(x for d in v for x in d) for k, v in want.items()}
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(places), -(-sum(r.length for r in got) // size)


def test_packing(spark):
    docs = sample(spark, "0.01").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    n, least = check_packing(pack(docs, WORD, 1, 4096).collect(), rows, 4096)
    assert least <= n <= least + 1
    n, least = check_packing(pack(docs, WORD, 1, 4096, block=300).collect(), rows, 4096)
    assert n <= least * 1.02 + 1


def test_packing_odd_rows(spark):
    check_packing(pack(clashing(spark), WORD, 1, 64).collect(), ODD, 64)
    assert pack(empty(spark), WORD, 1, 64).count() == 0


def test_local_search_empties_bins():
    # best fit leaves 3 bins: 6+3, 5+4 and 2; swapping can't beat 2 bins of 10
    lengths = np.array([6, 5, 4, 3, 2])
    bins = local_search(best_fit(lengths, 10), lengths, 10)
    assert len(bins) == 2
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 40, rng.integers(1, 60))
        start = best_fit(lengths, 50)
        bins = local_search([list(b) for b in start], lengths, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < lengths[b].sum() <= 50 for b in bins)
        assert len(bins) <= len(start)


def least_bins(lengths, size):
    """The exact optimum, by trying every bin for the longest first."""
    best = len(lengths)

    def deal(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                deal(i + 1, [*rest, r - lengths[i]])
        deal(i + 1, [*rooms, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    deal(0, [])
    return best


def test_local_search_against_optimum():
    rng = np.random.default_rng(2)
    found = best = start = 0
    for _ in range(150):
        lengths = rng.integers(8, 40, rng.integers(2, 13))
        first = best_fit(lengths, 60)
        bins = local_search([list(b) for b in first], lengths, 60)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        found, best, start = found + len(bins), best + least_bins(lengths.tolist(), 60), start + len(first)
    assert best <= found <= start
    assert found - best <= 0.01 * best


@pytest.mark.parametrize(("low", "high"), [(1300, 2300), (1, 4096), (1, 40), (900, 1100)])
def test_local_search_is_quick(low, high):
    import time

    lengths = np.random.default_rng(4).integers(low, high, 20_000)
    first, began = best_fit(lengths, 4096), time.time()
    bins = local_search([list(b) for b in first], lengths, 4096)
    assert time.time() - began < 60
    assert sorted(i for b in bins for i in b) == list(range(20_000))
    assert max(int(lengths[b].sum()) for b in bins) <= 4096
    assert len(bins) <= len(first)


def test_counts(spark, tmp_path):
    docs = sample(spark).select("doc_id", "text")
    lib = Tokenizer.from_file(BYTE)
    rows = [tuple(r) for r in docs.collect()]
    want = sorted((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows)
    cache = f"file://{tmp_path}/cache"
    half = docs.where("doc_id % 2 = 0")
    token_counts(half, BYTE, cache).count()
    before = spark.read.parquet(cache).count()
    assert rows_of(token_counts(docs, BYTE, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    after = spark.read.parquet(cache)
    # only misses were added, each once
    assert after.count() == after.select("digest").distinct().count() == docs.selectExpr("coalesce(text, '')").distinct().count() > before
    assert token_counts(docs, BYTE, cache).count() == len(rows)
    assert spark.read.parquet(cache).count() == after.count()


def test_counts_odd_rows(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    lib = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in ODD]
    got = rows_of(token_counts(clashing(spark), BYTE, cache), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    assert token_counts(empty(spark), BYTE, cache).count() == 0
