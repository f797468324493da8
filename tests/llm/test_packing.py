import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from opslens.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.vocabulary())


ODD = ["", None, "  \n\t ", "Hello, World!", "it's we've I'll x'd", "naïve ÀÉ ñandú straße", "ﬁ Å ΑΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|> c", "中文 字 mixed中文abc", "12 3.14 a1b2",
       "x y z\u0085w\x1cv", "é ́e", "İstanbul ǅ", "emoji 👍🏽 end", "!!!... ---", "a​b", "word's 'sword", "İ", "_under_score__", "tab\tnew\x0bline\x0cfeed"]


def test_word_encoder_equals_the_tokenizer(whole):
    encoder = packing.WordEncoder(packing.vocabulary())
    for text in ODD + [" ".join(t or "" for t in ODD)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_query_equals_the_tokenizer_and_packs_without_gaps(spark, whole):
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = packing.op8_best_fit_packing(spark, SF).toPandas()
    expected = []
    for i, text in zip(documents.doc_id, documents.text):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(expected)
    by_place = got.sort_values(["sequence_id", "offset"])
    assert (by_place.offset == by_place.groupby("sequence_id").length.cumsum() - by_place.length).all()
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= -(-got.length.sum() // 2048) + 1


def test_rows_of_every_kind(documents):
    df = documents((1, None), (1, None), (None, ""), (2, "word " * 5000), (3, "a b")).selectExpr("doc_id", "text", "source AS row", "source AS shard", "source AS bin")
    got = packing.pack(df, packing.vocabulary(), shard_rows=2).toPandas()
    assert sorted(got.length.tolist()) == [1, 1, 1, 3, 905, 2048, 2048]
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(df.where("false"), packing.vocabulary()).count() == 0


def test_many_shards_lose_and_repeat_nothing(documents):
    rng = random.Random(1)
    df = documents(*[(i, "word " * rng.randrange(1, 700)) for i in range(300)])
    got = packing.pack(df, packing.vocabulary(), shard_rows=40).toPandas()
    assert sorted(got.doc_id) == list(range(300))
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= 1.03 * -(-got.length.sum() // 2048) + 1


def test_evolution_never_gets_worse_and_reaches_a_perfect_packing():
    rng = random.Random(3)
    sizes = []
    for _ in range(20):  # bins that can be filled exactly
        cuts = sorted(rng.sample(range(1, 100), 2))
        sizes += [cuts[0], cuts[1] - cuts[0], 100 - cuts[1]]
    start = [[i] for i in range(len(sizes))]
    elite = packing.evolve(sizes, [start], 100, seed=1)
    for groups in elite:
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in g) <= 100 for g in groups)
    assert len(elite[0]) <= 22
    assert len(packing.evolve(sizes, elite, 100, seed=2)[0]) <= len(elite[0])


def test_crossover_keeps_every_item_once():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 60) for _ in range(80)]
    parents = []
    for _ in range(2):
        order = list(range(80))
        rng.shuffle(order)
        bins = packing.Bins(sizes, 100)
        bins.best_fit(order)
        parents.append(bins.groups)
    child = packing.crossover(sizes, *parents, 100, rng)
    assert sorted(i for g in child for i in g) == list(range(80)) and all(sum(sizes[i] for i in g) <= 100 for g in child)
