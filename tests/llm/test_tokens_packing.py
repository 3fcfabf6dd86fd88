"""Token counts and packing against the library itself."""

import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from understory.llm import token_counts as tc
from understory.llm import jaccard, tokens
from understory.llm.packing import Limits, pack

SCHEMA = "doc_id bigint, text string, n_tokens int, id int, content string, start int, length int"
SIGNS = ["a", "B", "word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'S", "it's", "1", "23", "é", "é", "\x1d", "\xa0", "\x0c", "\x00",
         "<|endoftext|>", "<|", "!!", "ſ", "Σ", "日本", "²", "ª", "İ", "　", "\x01", "\x02", "'", "ing", "Übung"]


def made_up(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, most))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 5, 6, "x", 7, 8) for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 50)  # the store starts afresh again and again
    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), made_up(3000, 1)
    enc = tokens.Encoder(path)
    for at in range(0, len(texts), 100):
        flat, counts = enc.encode(pa.array(texts[at:at + 100], pa.string()))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts[at:at + 100], ends - counts, ends):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts_and_cache(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    texts = made_up(60, 2) + [None, "", "same"] + ["same"] * 5 + ["long text, " * 20000]
    want = sorted((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts))
    assert sorted(map(tuple, tc.token_counts(frame(spark, texts), path, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    more = [*texts, "new one"]
    assert tc.token_counts(frame(spark, more), path, cache).count() == len(more)
    assert spark.read.parquet(cache).count() == len({t or "" for t in more})  # only the miss was appended
    # a stored count is what is used
    version = tc.tokenizer_version(path)
    assert spark.read.parquet(cache).filter(f"tokenizer <> '{version}'").count() == 0
    assert tc.token_counts(frame(spark, texts).limit(0), path, cache).count() == 0


def check_packing(rows, texts, library, limits, end_id):
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id]) for k, t in enumerate(texts)}
    seen, sequences = {}, {}
    for r in rows:
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(part) == r.length > 0 and part == ids[r.id][r.start:r.start + r.length] and r.doc_tokens == len(ids[r.id])
        seen.setdefault(r.id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, x in ids.items():
        at = 0
        for start, length in sorted(seen.get(k, [])):
            assert start == at
            at += length
        assert at == len(x)
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(part) <= limits.segments and sum(r.loss_tokens for r in part) <= limits.loss_tokens
    return sequences


@pytest.mark.parametrize(("limits", "pool"), [(Limits(64, 1000, 64), 4), (Limits(64, 3, 64), 16), (Limits(100, 8, 20), 2), (Limits(1, 1, 1), 3)])
def test_packing_holds_every_id_once(spark, limits, pool):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = made_up(80, 3, 40) + [None, "", "a " * 500, "b"] + ["copy of one"] * 10
    from pyspark.sql import functions as F
    got = pack(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json"), limits, 2, pool=pool, loss_start=F.col("doc_id") % 7 - 2).collect()
    check_packing(got, texts, library, limits, 2)


def test_little_padding_and_checksums(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"{'word ' * (k % 90)}" for k in range(400)]
    limits = Limits(256, 1024, 256)
    got = pack(frame(spark, texts).coalesce(1), public_tokenizers.path("word_bpe_49k.json"), limits, 2)
    sequences = check_packing(got.collect(), texts, library, limits, 2)
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert len(sequences) <= total // 256 + 9
    row = got.selectExpr("ids", "crc32(ids) as crc").first()
    assert row.crc == zlib.crc32(bytes(row.ids))


def test_documents_without_ids_and_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert pack(frame(spark, ["", None]), path).count() == 0
    assert pack(frame(spark, ["x"]).limit(0), path, end_id=2).count() == 0
    with pytest.raises(ValueError):
        pack(frame(spark, ["x"]), path, Limits(0, 1, 1))


@pytest.mark.parametrize("kind", ["smallint", "double", "date", "decimal(10,2)", "binary"])
def test_ids_of_any_type(spark, kind):
    from pyspark.sql import functions as F

    from understory.llm.chat import format_chats
    from understory.llm.packing import Limits, pack

    value = F.lit("2024-05-06").cast("date") if kind == "date" else F.lit("7").cast(kind)
    df = spark.createDataFrame([("user", "hello there", 1), ("assistant", "well", 2)], "role string, text string, turn bigint").withColumn("k", value)
    pieces = pack(df, public_tokenizers.path("word_bpe_49k.json"), Limits(64, 8, 64), 2, id_col="k")
    assert pieces.schema["id"].dataType == df.schema["k"].dataType and pieces.count() >= 2
    chats = format_chats(df, conv_col="k")
    assert chats.schema["conv_id"].dataType == df.schema["k"].dataType and chats.count() == 3


def test_an_encoder_is_dropped_when_its_worker_takes_up_other_work():
    path = public_tokenizers.path("word_bpe_49k.json")
    one = weakref.ref(tokens.encoder(path))
    assert tokens.encoder(path) is one()
    list(jaccard._runs(iter([]), 0))
    assert one() is None
