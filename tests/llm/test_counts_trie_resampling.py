"""Token counts, prefix tries and resampling against plain restatements."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from llm_helpers import prefix_nodes, resampled, sha
from test_tokens import random_texts
from tokenizers import Tokenizer

from parkpulse.llm import prefix_trie, resampling, token_counts
from parkpulse.llm.wordhash import text_buffers

BYTES = P.path("byte_bpe_50k.json")
TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def public_counts(texts):
    return [len(x.ids) for x in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


SPACES = ["a\xa0 b", "a \xa0b", "\xa0  b", "  　x", "x \n\n y", "\n\n'sx", " 's", "don't!'s'll", "it's1's", "\x1c a", "a\x85 b", "a \x85", "!'sand",
          "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endof", "text|>", "1a2b3", "é1é a", "́a ́", "   ", "\r\n\tx"]


def test_runs_have_the_tokens_of_whole_texts(corpus):
    texts = [t or "" for _, t in corpus] + random_texts() + SPACES + ["=" * 5000, " " * 9000, "the" * 3000, "🙂" * 500]
    lengths = token_counts.RunLengths(BYTES)
    plain = [t for t in texts if "<|endoftext|>" not in t]
    few = token_counts.Frequent(pa.array([b" the", b"the"], pa.binary()), np.array([1, 1], np.uint8))
    none = token_counts.Frequent(pa.array([], pa.binary()), np.zeros(0, np.uint8))
    for piece in (64, 5000, token_counts.PIECE_BYTES):
        for frequent in (few, none):
            raw, at = text_buffers(pa.array(plain))
            got = np.zeros(len(plain), np.int64)
            for first, n, data, edges in token_counts.blocks(raw, at, piece):
                got[first : first + n] += lengths.counts(data, edges, frequent)
            assert got.tolist() == public_counts(plain)


def test_a_worker_forgets_in_generations(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBER", 8)
    lengths = token_counts.RunLengths(BYTES)
    words = [f"word{i % 23}".encode() for i in range(200)]
    got = [int(lengths([w])[0]) for w in words]
    assert got == public_counts([w.decode() for w in words])
    assert len(lengths.known) + len(lengths.older) <= 12


def test_token_counts_of_a_table(spark, docs, corpus, no_docs, monkeypatch):
    rows = [*corpus, *enumerate(SPACES, 20_000), (None, "null id"), (20_000, "again"), (20_000, "again")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n_tokens int, n_bytes int").repartition(3)
    got = sorted(map(tuple, token_counts.token_counts(table, BYTES).collect()), key=str)
    counts = public_counts([t for _, t in rows])
    want = [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, counts, strict=True)]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs, BYTES, limit=1).count() == len(corpus)
    assert token_counts.token_counts(no_docs, BYTES).count() == 0


def test_frequent_runs_are_the_frequent_ones(spark):
    texts = ["the cat and the dog " * 50, "zebra" * 3, None, ""] * 3
    often = token_counts.frequent_runs(spark.createDataFrame([(t,) for t in texts], "text string"), limit=2)
    assert often[0] == b" the" and len(often) == 2


def test_op11(spark, sf, documents):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op11_token_counts(spark, sf).collect()}
    rows = documents.select("doc_id", "text").collect()
    for r, n in zip(rows, public_counts([r.text for r in rows]), strict=True):
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 512)


def test_double_array_holds_what_was_put_in():
    rnd = random.Random(5)
    words = [tuple(rnd.randrange(40) for _ in range(rnd.randint(1, 6))) for _ in range(800)]
    trie = prefix_trie.DoubleArray(40)
    states, paths = np.zeros(len(words), np.int64), {}
    for d in range(6):
        rows = np.array([i for i, w in enumerate(words) if len(w) > d])
        states[rows] = trie.extend(states[rows], np.array([words[i][d] for i in rows]))
        for i in rows:
            assert paths.setdefault(words[i][: d + 1], states[i]) == states[i]
    assert len(set(paths.values())) == len(paths)
    for path, state in paths.items():
        assert trie.walk(np.array([paths.get(path[:-1], 0)]), np.array([path[-1]]))[0] == state
        for c in range(40):
            if (*path, c) not in paths:
                assert trie.walk(np.array([state]), np.array([c]))[0] == -1


def trie_rows(df):
    return sorted(tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(df).collect())


@pytest.mark.parametrize("segment", [2, 16])
def test_trie_of_awkward_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", "a", "bb", None, "é🙂"])) for c in range(90, 230) for t in range(rnd.randint(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 480) for t in range(7)]  # a group of copies
    rows += [(600, t, "user", f"long {t % 5}") for t in range(150)]  # much longer than a segment
    rows += [(603, None, "user", "x"), (603, None, None, "y"), (603, 2, "a", "tie"), (603, 2, "b", "tie"), (603, 2, "b", "tie")]
    rows += [(-7, 1, "user", "minus"), (-205, 1, "u", "t"), (2**62, 0, "u", "t"), (701, 1, "u", "a"), (None, 1, "user", "no id")]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS + ", pos string, h int, k1 int").repartition(5)
    assert trie_rows(table) == prefix_nodes(rows)


def test_trie_of_few_and_none(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    # Conversation 1 loses its first turns, and there is no conversation 0 to give others.
    assert trie_rows(spark.createDataFrame([(1, 1, "u", "a")], TURNS)) == prefix_nodes([(1, 1, "u", "a")])


def test_op12(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r[c] for c in NODE) for r in prefix_trie.op12_prefix_trie(spark, sf).collect())
    assert got == prefix_nodes(rows)


def test_resampling_of_a_table(spark, docs, corpus):
    items = [(0, "one two three four"), (1, None), (2, corpus[3][1])]
    target = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in resampling.resample(docs, target).collect())
    assert got == resampled(corpus, items)


def test_pieces_do_not_change_features(corpus):
    texts = [t or "" for _, t in corpus] + ["x" * 700 + " y " + "z" * 400 + " " + "é" * 200, " ".join(["w"] * 900)]
    whole = None
    for piece in (50, 3000, resampling.PIECE_BYTES):
        counts, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, n, words, singles, of, pairs, of_pairs in resampling.bucketed(*text_buffers(pa.array(texts)), piece):
            counts[first : first + n] += words + np.diff(of_pairs)
            for b, o in ((singles, of), (pairs, of_pairs)):
                sums[first : first + n] += np.diff(np.concatenate([[0], np.cumsum(b.astype(np.int64))])[o])
        assert whole is None or (whole[0] == counts).all() and (whole[1] == sums).all()
        whole = counts, sums


def test_cut_by_bisection(spark):
    rnd = random.Random(1)
    values = [rnd.choice([-7, 3, 3, 3, 900, rnd.randrange(-(2**62), 2**62)]) for _ in range(200)] + [2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    order = sorted(values, reverse=True)
    for wanted in (1, 2, 40, 101, 150, 202):
        v, above = resampling.lowest_drawn(rows, "v", wanted)
        assert v == order[wanted - 1] and above == sum(x > v for x in values)
    assert resampling.lowest_drawn(rows, "v", 203) is None


def test_ties_are_cut_by_doc_id(spark):
    rows = [(5, 9), (3, 9), (4, 9), (None, 9), (1, 8), (2, 10), (4, 9)]
    scored = spark.createDataFrame(rows, "doc_id bigint, score bigint")

    def picked(n):
        return sorted([r.doc_id for r in scored.where(resampling.drawn(scored, n)).collect()], key=str)

    assert picked(1) == [2] and picked(2) == [2, 3] and picked(3) == picked(4) == [2, 3, 4, 4]
    assert picked(5) == [2, 3, 4, 4, 5] and len(picked(6)) == 6 and len(picked(7)) == 7


def test_resampling_with_nulls_and_repeats(spark, no_docs):
    text = "some words " * 15
    rows = [(1, text), (1, text), (1, text + "more"), (None, text), (None, None), (2, ""), (3, "few words")] * 2
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, rank int, score string, part int")
    target = spark.createDataFrame([("more words",), (None,)], "text string")
    got = resampling.resample(table, target, percent=70).collect()
    assert len(got) == len(rows)
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5]  # 70 % of 8
    assert resampling.resample(table, target, percent=100).where("rank is not null").count() == 8
    assert resampling.resample(table, target.limit(0), percent=5).where("rank is not null").count() == 0
    assert resampling.resample(no_docs, target).count() == 0


def test_op13(spark, sf, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in resampling.op13_target_resampling(spark, sf).collect()) == resampled(rows, items)
    assert sha("") == prefix_trie.hashlib.sha256().hexdigest()
