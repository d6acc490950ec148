"""Simple-8b words, shards and the digests of op13 against plain encodings."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import token_files
from tallyloom.llm.queries import BYTE_VOCABULARY, END_ID, op13_token_files
from tallyloom.llm.simple8b import COUNTS, ESCAPE, WIDTHS, ZEROS, Packed, pack, unpack
from tallyloom.llm.token_files import PieceEncoder, read_token_files, token_digests, write_token_files

ALPHABET = [" ", "  ", "\n", "a", "the", "'s", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "<|endoftext|>", "é", "日本", "😀",
            "1", "23", "!", "…", "\u200b", "\x00", "\u180e", "\ufeff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_VOCABULARY)


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def plain_words(values, block):
    """Word by word: of all selectors that fit at a place, the one that takes most numbers."""
    words, offsets, escapes = [], [0], []
    for low in range(0, len(values), block):
        part, at = values[low : low + block], 0
        while at < len(part):
            fits = [
                (COUNTS[k], -k) for k in range(ESCAPE) if all(v < 1 << int(WIDTHS[k]) for v in part[at : at + COUNTS[k]])
            ]
            if not fits:
                words.append((ESCAPE << 60) | len(escapes))
                escapes.append(part[at])
                at += 1
                continue
            kind = -max(fits)[1]
            word = kind << 60
            for place, v in enumerate(part[at : at + COUNTS[kind]]):
                word |= v << (place * int(WIDTHS[kind]))
            words.append(word)
            at += int(COUNTS[kind])
        offsets.append(len(words))
    return words, offsets, escapes


@pytest.mark.parametrize("block", [64, 300, 1024])
def test_words_equal_a_plain_coder_and_come_back(block):
    rng = np.random.default_rng(block)
    samples = [rng.integers(0, hi, n, dtype=np.uint64, endpoint=True) for n in (0, 1, 59, 61, 241, 1025) for hi in (0, 1, 200, 50257, 2**61)]
    samples += [np.array([2**64 - 1, 0, 2**60, 2**60 - 1, 2**53 + 1, 2**53 - 1] * 50, np.uint64)]
    samples += [np.ones(700, np.uint64) << rng.integers(0, 64, 700).astype(np.uint64)]
    for values in samples:
        packed = pack(values, block)
        words, offsets, escapes = plain_words([int(v) for v in values], block)
        # Equal counts: zeros beyond the end may be taken as a run or as narrow numbers.
        assert packed.offsets.tolist() == offsets and packed.escapes.tolist() == escapes
        assert (unpack(packed, len(values), block) == values).all()
        assert len(words) == len(packed.words)


def test_a_range_of_blocks_is_decoded_by_itself():
    values = np.random.default_rng(1).integers(0, 2**62, 5000, dtype=np.uint64)
    packed = pack(values, 256)
    low, high = packed.offsets[3], packed.offsets[7]
    some = Packed(packed.words[int(low) : int(high)], packed.offsets[3:8], packed.escapes)
    assert (unpack(some, 1024, 256) == values[768:1792]).all()


def test_pieces_encode_as_whole_texts(library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += [" ".join(rng.choice(ALPHABET) for _ in range(12)) for _ in range(3000)]
    encoder = PieceEncoder(BYTE_VOCABULARY)
    for window, remembered in ((1 << 20, 1 << 20), (5, 40)):
        monkeypatch.setattr(token_files, "WINDOW", window)
        monkeypatch.setattr(token_files, "REMEMBERED", remembered)
        for text in texts:
            assert encoder.encode(text) == np.array(plain_ids(library, text), "<u4").tobytes(), repr(text)


def expected(library, rows):
    """Digests in the order of doc_id (NULL first); rows must not share a doc_id."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain_ids(library, text), END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digests(df):
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_nulls_empty_and_very_long_texts(library, docs_of):
    rows = [(7, None), (None, "no id"), (3, ""), (-4, "a b"), (9, "long text " * 200_000), (8, "x" * 300_000), (5, "<|endoftext|>")]
    assert digests(token_digests(docs_of(rows, 3), BYTE_VOCABULARY, END_ID)) == expected(library, rows)


def test_empty_table(docs_of):
    assert digests(token_digests(docs_of([]), BYTE_VOCABULARY, END_ID)) == []


def test_a_doc_id_in_a_third_of_the_rows(library, docs_of):
    rows = [(1, f"text {i % 40}") for i in range(100)] + [(i, f"other {i}") for i in range(100, 300)]
    found = digests(token_digests(docs_of(rows, 5), BYTE_VOCABULARY, END_ID))
    assert [r[0] for r in found] == [1] * 100 + list(range(100, 300))
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found[:-1]]).tolist()
    crc = lambda text: zlib.crc32(np.array([*plain_ids(library, text), END_ID], "<u4").tobytes())
    assert sorted(r[3] for r in found) == sorted(crc(text) for _, text in rows)


def test_files_hold_all_ids_whatever_the_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 2 * token_files.BLOCK)
    ids = [np.random.default_rng(i).integers(0, 50257, i * 13).astype("<u4") for i in range(200)]
    sink = pa.BufferOutputStream()
    file = token_files._ShardWriter(sink)
    file.add([None, *range(1, 200)], [i.tobytes() for i in ids])
    file.finish()
    back = pa.Table.from_batches(token_files._read_shard(pa.BufferReader(sink.getvalue()), 1000))
    assert back.column("doc_id").to_pylist() == [None, *range(1, 200)]
    assert back.column("ids").to_pylist() == [i.tobytes() for i in ids]
    assert back.column("start").to_pylist() == (1000 + np.cumsum([0] + [len(i) for i in ids[:-1]])).tolist()


def test_a_folder_is_written_once_and_keeps_stray_files_out(spark, docs_of, tmp_path):
    path = str(tmp_path / "ids")
    write_token_files(docs_of([(1, "one"), (2, "two words")]), path, BYTE_VOCABULARY)
    (tmp_path / "ids" / "ids-000000-stray.s8b").write_bytes(b"of a failed task")
    assert read_token_files(spark, path).count() == 2
    with pytest.raises(Exception, match="holds token files already"):
        write_token_files(docs_of([(1, "one")]), path, BYTE_VOCABULARY)
    assert read_token_files(spark, path).agg(F.sum("doc_id")).first()[0] == 3


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert digests(op13_token_files(spark, folder)) == expected(library, rows)


def test_vocabulary_is_the_public_file():
    assert BYTE_VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
