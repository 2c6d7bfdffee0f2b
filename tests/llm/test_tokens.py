"""Token files: round trip against the tokenizer itself, single documents, broken files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from siftline.llm import tokens
from siftline.llm.common import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, frame int, n double"


def corpus():
    r = random.Random(6)
    parts = ["word", "Word,", "don't", "it's''s", "été", "naïve", "日本語", "12345", "a1b2", "...", " ", "  ", "\n", "\n\n", "\t", "\x1f", "\x85", " ", "　", " ", "<|endoftext|>", "é", "😀", "×", "'ll", "_x_", "\x00"]
    out = ["".join(r.choice(parts) + r.choice(["", " ", " ", "\n"]) for _ in range(r.choice([1, 3, 30, 300]))) for _ in range(80)]
    return out + [None, "", " ", "\n", "x", "wordword" * 4000, " a" * 9000]


def rows_of(df, name="id"):
    key = lambda r: (r.start, r.n_tokens)
    return [(r[name], r.start, r.n_tokens, bytes(r.ids)) for r in sorted(df.collect(), key=key)]


@pytest.mark.parametrize("file,end,part,shard", [("byte_bpe_50k.json", 2, 4 << 20, 128 << 20), ("byte_bpe_50k.json", 70_000, 50, 2000), ("word_bpe_49k.json", 2, 4 << 20, 2000)])
def test_round_trip(spark, monkeypatch, file, end, part, shard):
    """By pieces, in parts of a few characters, in 4 bytes an id, and with a tokenizer that takes whole texts; several shards."""
    monkeypatch.setattr(tokens, "PART_CHARS", part)
    monkeypatch.setattr(tokens, "SHARD_BYTES", shard)
    path = public_tokenizers.path(file)
    given = [(7 * i % 101 - 9, t) for i, t in enumerate(corpus())]
    given += [given[2], given[2], (None, given[4][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in given], SCHEMA).repartition(3)
    folder = shared_dir(spark)
    shards = tokens.write_tokens(df, folder, path, end)
    assert shards.count() > 1 or shard > 10**6
    plain = Tokenizer.from_file(path)
    ids = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in given]
    got = rows_of(tokens.read_tokens(spark, folder))
    assert sorted((str(i), x.tobytes()) for i, x in ids) == sorted((str(i), x) for i, _, _, x in got)
    names = [i for i, *_ in got]
    assert names == sorted(names, key=lambda i: (i is None, i or 0))
    before = 0
    for _, start, n, x in got:
        assert start == before and len(x) == 4 * n
        before += n
    wanted = spark.createDataFrame([(i,) for i in (given[2][0], given[0][0], given[0][0], 10**9, None)], "doc_id long")
    found = rows_of(tokens.find_tokens(spark, folder, wanted))
    assert found == [r for r in got if r[0] in (given[2][0], given[0][0])] and len(found) >= 4


def test_orphans_and_other_dictionaries(spark):
    df = spark.createDataFrame([(i, "some words %d" % i) for i in range(50)], "doc_id long, text string")
    folder = shared_dir(spark)
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/tokens-lost") as f:
        f.write(b"half a file")
    shards = tokens.write_tokens(df, folder, BPE, 2).collect()
    left = {x.base_name for x in files.get_file_info(pyarrow.fs.FileSelector(path)) if x.base_name.startswith("tokens-")}
    assert left == {r["file"] for r in shards}
    name = f"{path}/{shards[0]['file']}"
    dictionary = tokens.dictionary_of(files, path, shards[0]["dictionary"])
    with files.open_input_file(name) as f:
        assert tokens.Shard(f, dictionary).docs == 50
        with pytest.raises(ValueError, match="dictionary"):
            tokens.Shard(f, dictionary + b"x")
        whole = f.read_at(f.size(), 0)
    with files.open_output_stream(name) as f:
        f.write(whole[:-5])
    with files.open_input_file(name) as f, pytest.raises(ValueError, match="whole"):
        tokens.Shard(f, dictionary)


def test_dictionary_helps_short_documents(spark):
    r = random.Random(1)
    vocabulary = ["term%d" % i for i in range(300)]
    encoder = tokens.Encoder(open(BPE, encoding="utf-8").read(), 2, 2)
    texts = [encoder(" ".join(r.choices(vocabulary, k=60))) for _ in range(600)]
    dictionary = tokens.train_dictionary(texts[:500])
    import zstandard

    size = lambda **k: sum(len(zstandard.ZstdCompressor(level=3, **k).compress(t)) for t in texts[500:])
    assert 0 < len(dictionary) <= tokens.DICTIONARY_BYTES and size(dict_data=tokens.shared(dictionary)) < 0.9 * size()
    assert tokens.train_dictionary([]) == b"" and tokens.shared(b"") is None


def test_query(spark):
    from siftline.llm import queries

    d = "/root/testdata/sf0.001"
    plain, before = Tokenizer.from_file(BPE), 0
    got = {r.doc_id: r for r in queries.op13_tokens(spark, d).collect()}
    given = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(given)
    for r in given:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)


def test_empty_table(spark):
    folder = shared_dir(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert tokens.write_tokens(none, folder, BPE, 2).count() == 0
    assert tokens.read_tokens(spark, folder).count() == 0
    assert tokens.find_tokens(spark, folder, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_pieces_are_asked_for_once(monkeypatch):
    """An encoder stays with its worker, asks for a piece while it holds it no more, and gives what the tokenizer gives, also where it drops pieces."""
    with open(BPE, encoding="utf-8") as f:
        spelt = f.read()
    encoder, plain = tokens.encoder_of(spelt, 2, 2), Tokenizer.from_file(BPE)
    assert tokens.encoder_of(spelt, 2, 2) is encoder
    want = [tokens.Encoder.put(2, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for t in corpus()]
    assert [encoder(t) for t in corpus()] == want
    n = len(encoder.held)
    assert [encoder(t) for t in corpus()] == want and len(encoder.held) == n > 0 and max(map(len, encoder.held)) <= tokens.HELD_CHARS
    monkeypatch.setattr(tokens, "HELD_PIECES", 3)
    few = tokens.Encoder(spelt, 2, 2)
    assert [few(t) for t in corpus()] == want and len(few.held) <= 3
