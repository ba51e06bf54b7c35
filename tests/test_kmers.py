"""Tokens: hand-computed values, the native expression against the Arrow one."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ribospark.functions import kmers as K
from ribospark.functions.kmer_arrays import kmer_array
from ribospark.operators.train import tokenise

SEQ = "ATGCGCTAGTAGCATGC"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def by_hand(seq, k, fold=True):
    digits = {"A": 0, "C": 1, "G": 2, "T": 3}
    seq = seq.upper() if fold else seq
    found = set()
    for i in range(len(seq) - k + 1):
        w = [digits.get(c) for c in seq[i : i + k]]
        if None not in w:
            found.add(sum(d * 4 ** (k - 1 - j) for j, d in enumerate(w)))
    return sorted(found)


def test_all_kmers_in_order(spark):
    assert value(spark, K.all_kmers(F.lit(SEQ), 8)) == [SEQ[i : i + 8] for i in range(10)]
    assert value(spark, K.all_kmers(F.lit("ATG"), 8)) == [] and value(spark, K.all_kmers(F.lit(""), 8)) == []


def test_base4(spark):
    assert value(spark, K.base4(F.lit(SEQ))) == "03212130230210321"
    assert value(spark, K.base4(F.lit("atgcgctantrgcatgc"))) == "0321213" + "0N3N210321"
    assert value(spark, K.base4(F.lit("aC"), fold_case=False)) == "N1"
    assert value(spark, K.base4_list(F.array(F.lit("AC"), F.lit("gx")))) == ["01", "2N"]


def test_base4_to_index_keeps_order_and_drops_n(spark):
    words = F.array(*map(F.lit, ("0000", "1000", "0N00", "0123", "0000")))
    assert value(spark, K.base4_to_index(words)) == [0, 64, 27, 0]


def test_indices_back_to_bases(spark):
    assert value(spark, K.index_to_base4(F.lit(255), 8)) == "00003333"
    assert value(spark, K.index_to_base4(F.lit(4**8 + 1), 8)) == "00000001"
    assert value(spark, K.base4_to_nucleotide(F.lit("00003333"))) == "AAAATTTT"
    assert value(spark, K.base4_to_nucleotide_list(F.array(F.lit("01"), F.lit("23")))) == ["AC", "GT"]


def test_padding(spark):
    assert value(spark, K.pad_kmers(F.array(F.lit(3)), 3)) == [3, -1, -1]
    with pytest.raises(Exception, match="padded length"):
        value(spark, K.pad_kmers(F.array(F.lit(3), F.lit(4)), 1))


def test_k_is_bounded():
    with pytest.raises(ValueError, match="k must be"):
        K.kmer_indices(F.lit("0"), 16)


CASES = [SEQ, SEQ + "N", SEQ.lower(), "ACGT" * 30, "NNNN", "", "AC", "ACGTNACGU", "ACÉGTACGTA", None]


@pytest.mark.parametrize("fold", [True, False])
def test_native_and_arrow_tokens_agree_with_hand_values(spark, fold):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "seq_no long, sequence string")
    for native in (True, False):
        got = {r.seq_no: r.kmers for r in tokenise(rows, 3, fold, native=native).collect()}
        assert got == {i: by_hand(s or "", 3, fold) for i, s in enumerate(CASES)}, native


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNacgtu-", max_size=60), st.integers(1, 8))
def test_tokens_are_sorted_distinct_and_right(seq, k):
    assert kmer_array(seq, k, True).tolist() == by_hand(seq, k)
    assert kmer_array(seq, k, False).tolist() == by_hand(seq, k, False)
