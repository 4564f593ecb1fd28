"""What the review of round 1 found missing, against brute force."""

import numpy as np
import pytest

from shelfmark.llm import simhash


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _near(a, b):
    return len(a & b) / len(a | b) >= 0.8


def _removed(texts):
    """Ids that brute force removes: all of each group but the smallest."""
    sets, group = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and _near(sets[i], sets[j]):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return {i for i, g in enumerate(group) if g != i}


def _found(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id for r in simhash.duplicate_rows(docs).collect()}


@pytest.mark.parametrize("block", [2048, 2])
def test_block_append_and_cut_edits(spark, monkeypatch, block):
    """Copies with a replaced, appended or cut paragraph; with 2, lists and clusters of over two texts are dealt out."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SETS", block)
    rng, texts = np.random.default_rng(3), []
    new = lambda n: [f"w{i}" for i in rng.integers(0, 20_000, n)]
    passage = new(60)
    for k in range(12):
        a = passage + new(240) if k % 2 else new(300)
        i, n = int(rng.integers(60, 240)), int(rng.integers(18, 30))
        texts += [a, a[:i] + new(n) + a[i + n :], a + new(2 * n), a[: 300 - 2 * n]]
    want = _removed(texts)
    assert len(want) > 30 and _found(spark, texts) == want


@pytest.mark.parametrize("sets", [1024, 40])
def test_large_group_whose_closest_texts_fall_short(spark, monkeypatch, sets):
    """A group that hangs together by Jaccard, though not along the least Hamming distances of its fingerprints."""
    monkeypatch.setattr(simhash, "SETS", sets)
    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in rng.integers(0, 20_000, 400)], []
    for _ in range(250):
        t = list(base)
        for p in rng.choice(400, int(rng.integers(1, 15)), replace=False):
            t[p] = f"e{rng.integers(10**6)}"
        texts.append(t)
    assert _found(spark, texts) == _removed(texts)


def test_added_tokens_as_the_library(spark):
    """At its defaults the library gives added tokens in a text their ids."""
    import zlib

    from public_tokenizers import path
    from tokenizers import Tokenizer

    from shelfmark.llm.queries import QUERIES

    file = path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    texts = ["a <|endoftext|> b", "plain words", None, "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  z", "<|endoftext|", "", "last one"]
    folder = tmp_table(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in QUERIES["op5_token_id_binary"](spark, folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), t
        start += len(ids)


def tmp_table(spark, rows):
    """A folder of its own that has these documents."""
    from shelfmark.llm.common import new_path

    folder = new_path(spark, "advice")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_decontamination_judges_rows_by_their_own_text(spark):
    import corpus_pipeline
    from shelfmark.llm.common import new_path

    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"before {item} after"), (None, "a clean text of some words"), (3, "one two three four five six seven"), (3, "four five six seven eight nine ten"), (4, None), (5, item)]
    folder = new_path(spark, "advice")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:5], key=str)


@pytest.mark.parametrize("repeated", [False, True])
def test_null_ids_take_part_in_near_dedup(spark, repeated):
    """Whether a row without an id stays depends on its own group, and not on ids elsewhere that repeat."""
    import corpus_pipeline

    rng = np.random.default_rng(2)
    new = lambda: " ".join(f"w{i}" for i in rng.integers(0, 20_000, 100))
    a, b, c, d = new(), new(), new(), new()
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " more"), (None, c), (2, d)] + [(2, d), (2, new())] * repeated
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    texts_b = [t for _, t in got if t in (b, b + " more")]
    assert len(texts_b) == 1 and [x for x in got if x[1] not in (b, b + " more")] == sorted([(1, a), (None, c), (2, d), *rows[8:]], key=str)
