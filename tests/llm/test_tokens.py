"""Encoders against the public libraries, and the token files."""

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from llm_helpers import sha
from tokenizers import Tokenizer

from parkpulse.llm import bpe, token_files
from parkpulse.llm.merge_replay import BlockEncoder, MergeTable, merge_table
from parkpulse.llm.wordhash import text_buffers

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
LETTERS = "aAbB.,;.%&#$'s's \t\n\r\x1c\x1d\x85\xa0  éÉΣσς'sted1½²ＡＢß語中文ก็́🙂_-!!the İ"


def random_texts(n=3000):
    rnd = random.Random(2)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_merge_replay_equals_the_public_encoder(corpus):
    table = merge_table(RANKS)
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    texts = [t or "" for _, t in corpus] + random_texts() + ["a" * 3000, " " * 9000, "\n" * 99, "=" * 5000, "thethe" * 500]
    got = BlockEncoder(table, P.PATTERN).ids(texts)
    for ids, text in zip(got, texts, strict=True):
        assert ids.tolist() == public.encode_ordinary(text)
        assert table.decode(ids).tobytes() == text.encode()


def test_replay_of_a_vocabulary_with_late_pairs():
    """Merging b and c forms a pair with a that ranks before it."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"abcabc": 258}
    public = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abc", b"abcabc", b"xbcbcabcbc", b"bcabcbcabca", b"abcabcabc"]
    got = MergeTable(ranks).encode(words)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [public.encode_ordinary(w.decode()) for w in words]


def test_round_trip_of_a_table(docs, corpus, no_docs):
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: sha(t or "") for i, t in corpus}
    assert got[10_000].n_tokens == 0
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded, RANKS).collect()} == {i: t or "" for i, t in corpus}
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0


def test_words_encode_as_whole_texts():
    public = Tokenizer.from_file(WORDS)
    encoder = token_files.WordEncoder(public)
    texts = random_texts()
    for block in (texts, texts[:5] + ["<|endoftext|> x<|startoftext|>y", "<|x"], [""], ["", "", " "]):
        ids, offsets = encoder.ids(*text_buffers(pa.array(block)))
        whole = public.encode_batch(block, add_special_tokens=False)
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(block))] == [[*x.ids, 1] for x in whole]


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tokens") / "files")
    token_files.write_ids(docs, WORDS, folder, files=3)
    return folder


def test_token_files(spark, folder, corpus):
    files = spark.read.schema(token_files._SCHEMA).parquet(folder)
    got = {r.doc_id: r for r in token_files.checksums(token_files.document_starts(files)).collect()}
    public, start = Tokenizer.from_file(WORDS), 0
    for doc_id, text in sorted(corpus):
        ids = [*public.encode(text or "", add_special_tokens=False).ids, 1]
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not got


def test_layout_of_token_files(spark, folder):
    for path in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        ids = meta.row_group(0).column(meta.num_columns - 1)
        assert ids.path_in_schema.startswith("ids") and ids.has_column_index and ids.has_offset_index
        assert any("DICTIONARY" in e or "DELTA" in e for e in ids.encodings)
    files = spark.read.schema(token_files._SCHEMA).parquet(folder)
    plan = files.groupBy("part").sum("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<part:int,n_tokens:bigint>" in plan


def test_no_documents_give_no_ids(no_docs, tmp_path):
    files = token_files.write_ids(no_docs, WORDS, str(tmp_path / "none"))
    assert token_files.checksums(token_files.document_starts(files)).count() == 0


class Counting:
    """A tokenizer that counts the texts it is given at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def word_ids(encoder, texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, offsets = encoder.ids(np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[a:z].tolist() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def test_new_runs_are_encoded_together_and_common_ones_kept(monkeypatch):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_files, "REMEMBER", 60)
    encoder = token_files.WordEncoder(Counting(tokenizer))
    odd = ["", " ", "'s 's", "́a ́", "Ab,'ll;x", "a  ", "　 b", "1 23.4", "it's <b> <", "Å̇"]
    common = [" ".join(f"word{i % 7}" for i in range(20))]
    for block in range(8):
        rare = [" ".join(f"r{block}x{i}" for i in range(25))]
        texts = [*odd, *common, *rare]
        assert word_ids(encoder, texts) == [[*tokenizer.encode(t, add_special_tokens=False).ids, token_files.END] for t in texts]
    assert encoder.tokenizer.texts <= 8
    assert b" word1" in encoder.known and b" r0x3" not in encoder.known
    # The word that stands between runs may be in a text as well.
    texts = ["a \x01 b", "\x01,\x01", "c\x01d <|x"]
    for t in (texts[:2], texts):
        assert word_ids(encoder, t) == [[*tokenizer.encode(x, add_special_tokens=False).ids, token_files.END] for x in t]
