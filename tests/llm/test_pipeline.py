"""The pipeline's stages on the smallest tables, and the guard that lets the rest live without this subpackage."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from shelfmark.llm.common import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := written(stage(spark, docs, SF), "stage")))
    return out


def test_columns(stages):
    assert all(b.columns == a.columns for a, b in stages[:-1]) and stages[-1][1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_keeps_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.98 and sum(d in kept for d, q in labels.items() if q == 0) <= 1


def test_near_dedup_against_brute_force(stages):
    docs, kept = ({r.doc_id: r.text for r in df.collect()} for df in stages[1])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in docs.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    gone = set(docs) - set(kept)
    assert all(any(o != g and near(g, o) for o in docs) for g in gone)  # nothing clean goes
    left = sum(near(a, b) for a in kept for b in kept if a < b)
    assert left <= 0.1 * max(1, len(gone))


def test_no_leaks_remain(spark, stages):
    from shelfmark.llm.decontam import contaminated

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contaminated(stages[2][0], items).count() > 0 and contaminated(stages[2][1], items).count() == 0


def test_tokens_cover_the_mix(stages):
    rows = sorted(stages[4][1].collect(), key=lambda r: r.start)
    assert len(rows) == stages[4][0].count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, _id long, _k int, _copies int, copies int, row string, node long, d string"


def _odd(spark):
    clean = [" ".join(f"word{(k * 7 + i * 3) % 400} and" for i in range(60)) + "." for k in range(12)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None) for k, t in enumerate(clean)]
    rows += [(None, None, None, None), (None, clean[3], "en", "s0"), (50, "", "en", "s1"), (51, " \n ", "en", "s1"), (52, "x " * 40_000, "en", "s2"), (4, clean[4], "en", "s1"), (4, clean[4], "en", "s1"), (53, "long " + "z" * 200_000, "en", "s0"), (None, "one two three four five six seven eight nine", "en", "s0")]
    return spark.createDataFrame([(*r, None, "x", 1, 2, 3, 4, "r", 5, "d") for r in rows], ODD)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    """Nulls in every column, empty and long texts, repeated rows, columns of clashing names, and an empty table."""
    import corpus_pipeline

    docs = _odd(spark)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    rows = out.collect()
    given = [tuple(r) for r in docs.collect()]
    if k < 4:
        assert out.columns == docs.columns and all(tuple(r) in given for r in rows)
    else:
        assert len(rows) == len(given) and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    if name.startswith("simhash"):
        assert len([r for r in rows if r.doc_id == 4]) == 1 and len([r for r in rows if not (r.text or "").strip()]) == 2
        assert [r.doc_id for r in rows if r.text and r.text == given[3][1]] == [3]
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
