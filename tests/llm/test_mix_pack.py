import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from engrama.llm import mixing, packing
from engrama.llm.queries import QUERIES
from tests.llm.data import TEXTS, awkward, documents, empty
from tests.llm.test_dedup import WORD, lines_brute, near_brute


def check_mix(rows, sizes):
    by = defaultdict(list)
    for r in rows:
        by[r["skey"]].append(r)
    total = sum(sizes.values())
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    for own in by.values():
        size, target = own[0]["source_size"], own[0]["target"]
        assert sum(r["size"] for r in own) == size and target <= 3 * size + 1e-6
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) * max(Counter(r["doc_id"] for r in own).values())


def test_mix_awkward(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == len(TEXTS)
    check_mix(rows, Counter({k: len(WORD.findall(r[1] or "")) for k, r in enumerate(TEXTS)}))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_rows(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).where("taken > 0").collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_water_filling(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(900, "a"), (50, "b"), (10, "c"), (0, "d")])]
    got = {r["skey"][1:]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {"a": pytest.approx(780.0), "b": 150.0, "c": 30.0, "d": 0.0}


def test_reruns_agree(spark, sf):
    one, two = (sorted(QUERIES["op8_mix_sources"](spark, sf).collect()) for _ in range(2))
    assert one == two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_the_tightest(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    free: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [c for c in free if c >= lengths[k]]
        if fits:
            best = min(fits)
            assert offsets[k] == 64 - best
            free.remove(best)
        else:
            best = 64
            assert offsets[k] == 0
        free.append(best - lengths[k])
    for b in set(bins.tolist()):
        own = sorted((offsets[k], lengths[k]) for k in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 64


ODD = ["", " ", "Hello, World!! it's  a test's 'quoted' <|endoftext|> x<|startoftext|>", "naïve ÄÖÜ ﬁ é   nbsp em", "漢字 123abc 4.5 --- ...!?", "ΟΔΥΣΣΕΥΣ İstanbul ẞ ſ", "word." * 100, "a" * 300 + ",", "tab\tnew\r\nline\x0b\x0c", "x!'s y..'t 'RE"]


@pytest.mark.parametrize("text", ODD)
def test_word_tokenizer_equals_the_library(text):
    path = packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    own = packing.WordTokenizer(path)
    for _ in range(2):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want


def check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            want[(i, start, len(ids), np.array(ids[start : start + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(sequences))


def test_pack_awkward(spark):
    check_pieces(packing.pack(awkward(spark)).collect(), [(r[0], r[1]) for r in TEXTS])
    assert packing.pack(empty(spark)).count() == 0


def test_pack_flushes_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in documents(sf)]
    assert check_pieces(packing.pack(docs).collect(), texts) > 0.97
    check_pieces(packing.pack(docs, block_tokens=5000).collect(), texts)


def test_pack_query_digests(spark, sf):
    pieces = {(r["doc_id"], r["start"]): r for r in packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in QUERIES["op6_pack"](spark, sf).collect():
        assert r["ids_crc32"] == zlib.crc32(pieces[r["doc_id"], r["start"]]["ids"])


def test_pipeline_stages(spark, sf):
    """Each stage against a brute-force version of it on what the stage before has kept."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = [r.asDict() for r in out.collect()]
        seen.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    given_, (good, lines, near, mix) = documents(sf), seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert all(r in given_ for r in good)
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    text = [(r["doc_id"], r["text"]) for r in good]
    want = {i: t for (i, old), t in zip(text, lines_brute(text), strict=True) if t == old or WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    now = [(r["doc_id"], r["text"]) for r in lines]
    before = {r["doc_id"]: r["text"] for r in given_}
    both = near_brute(now + [(i, before[i]) for i, t in now if before[i] != t], 5)
    assert {r["doc_id"] for r in near} == {i for i, _, c in both if i == c} and len(near) < len(lines)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(near, docs.schema)).where("taken > 0").collect()}
    assert Counter(r["doc_id"] for r in mix) == {i: n for i, n in plan.items() if n}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), [(r["doc_id"], r["text"]) for r in mix])


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ids given twice and an empty table, stage by stage."""
    folder = str(tmp_path)
    given_ = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars", "keep_id", "digest")
    for docs in (given_, given_.where("false")):
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (9, 0), (4, 0)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        for name, function in corpus_pipeline.STAGES:
            if name == "mixing":
                rows = [tuple(r) for r in docs.collect()]
                assert len(rows) == len(set(rows)), "repeated rows go with the near copies"
            before, docs = docs, function(spark, docs, folder)
            if name != "packing":
                assert docs.columns == before.columns
            docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)


def test_pipeline_catches_near_copies(spark, tmp_path):
    """A near copy of which line dedup leaves a stump goes with its stump; a document that only shares a line stays."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    body = [words(12) for _ in range(20)]
    rows = [(1, "\n".join(body)), (2, "\n".join([*body[:19], words(12)])), (3, "\n".join([body[0], *(words(12) for _ in range(12))]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["line dedup"](spark, docs, str(tmp_path))
    assert left.count() == 3
    assert sorted(r["doc_id"] for r in stages["near-dedup"](spark, left, str(tmp_path)).collect()) == [1, 3]


def test_small_partitions_are_packed_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(50)
    assert check_pieces(packing.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in documents(sf)]) > 0.97


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "mixing", "packing"]
