"""The pipeline's stages against their operators' brute force, and its shape."""

import importlib
from collections import Counter

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from ribospark.llm.common import materialize

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        out.append((name, docs, docs := materialize(stage(spark, docs, SF), "test")))
    return out


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _, _ in stages] == [n for n, _ in p.STAGES] and len(stages) == 5
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_quality_drops_rejected_documents_only(spark, stages):
    _, before, after = stages[0]
    assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0


def test_one_document_of_each_group_stays(spark, stages):
    from test_text_ops import linked

    _, before, after = stages[1]
    groups = Counter(c for _, _, c in linked([(r.doc_id, r.text) for r in before.collect()]))
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups)


def test_leaks_go(spark, stages):
    _, before, after = stages[2]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in before.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    kept = {r.doc_id for r in after.collect()}
    assert not holds & kept and len({r.doc_id for r in before.collect()} - kept - holds) <= 1


def test_mixture_repeats_whole_documents(spark, stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert all(texts[r.doc_id] == r.text for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 3


def test_sharding_takes_every_row(spark, stages):
    _, before, after = stages[4]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())


def test_repeated_rows_in_the_near_duplicate_stage(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "other words are in here"), (None, "x"), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.doc_id for r in p.near_duplicates(spark, df, SF).collect())
    assert got == Counter([1, 3, None, 4])


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    import random

    from test_text_ops import shingles, union_find

    rng, rows = random.Random(5), []
    for i in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(30)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 30 - i % 8]))]
    sets = {i: shingles(t, 5) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any(100 * len((a := shingles(rows[x][1], 4)) & (b := shingles(rows[y][1], 4))) < 85 * len(a | b) for x, y in edges)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.near_duplicates(spark, df, SF).collect()} == set(union_find(list(sets), edges).values())


def test_sharded_rows_keep_their_columns(spark, stages):
    _, before, after = stages[4]
    assert set(before.columns) <= set(after.columns)
    assert Counter(tuple(r) for r in after.select(before.columns).collect()) == Counter(tuple(r) for r in before.collect())
    slots = {}
    for r in after.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


ODD = [
    (1, "Some plain words of a usual text, long enough.", "en", None), (1, "Some plain words of a usual text, long enough.", "en", None), (2, None, None, "s"), (None, "no id here", "en", "s"),
    (None, None, None, None), (3, "", "en", "s"), (4, " \n\t", "en", ""), (5, "w" * 200_000, "en", "s"), (6, "many words " * 40_000, "en", "t"), (7, "\u00e9\u2028\x1f", "fr", "t"),
]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_in_each_stage(spark, k):
    name, stage = p.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, node string, tokens int, score double, _id int, h string"
    df = spark.createDataFrame([(*r, 1, 2, "x", "n", 3, 0.5, 4, "h") for r in ODD], schema).repartition(3)
    got, given = stage(spark, df, SF), Counter(tuple(r)[:5] for r in df.collect())
    rows = got.collect()
    if k < 4:
        assert got.columns == df.columns and {tuple(r)[:5] for r in rows} <= set(given)
    else:
        assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows) == given and {"node", "tokens", "h"} <= set(got.columns)
    if k in (0, 2):
        assert all(Counter(tuple(r)[:5] for r in rows)[x] in (0, given[x]) for x in given)
    if k == 2:
        assert len(rows) == len(ODD)
    if k == 1:
        assert Counter(tuple(r)[:5] for r in rows) == Counter(set(given))
    none = stage(spark, df.limit(0), SF)
    assert none.columns == got.columns and none.collect() == []


def test_entry_lists_all_operators():
    entry = importlib.import_module("__spark_entry__")
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{i}" for i in range(1, 11)} <= names and "pipeline" in names
