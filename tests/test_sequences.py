"""Splits, sequences and masks: properties that hold for every input."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import layout, masking, sequence, tokens
from tributary.operators.split import HashSplit, restore_split, shared_keys
from tributary.plans.datasets import ACTIVITY
from tributary.plans.jobs import Encoder, sequence_table

SF = "/root/testdata/sf0.001"
N = ACTIVITY.schema.n_cols
L = 10


@pytest.fixture(scope="module")
def prepared(spark):
    events = ACTIVITY.normalise(spark.read.parquet(f"{SF}/events.parquet")).cache()
    return events, Encoder.fit(events, ACTIVITY.schema)


@pytest.fixture(scope="module")
def seqs(prepared):
    return sequence_table(*prepared, L).cache()


def test_shape_markers_and_padding(prepared, seqs):
    rows = seqs.collect()
    row_id = prepared[1].vocabulary.where("token = '[ROW]'").first()["id"]
    for r in rows:
        ids, mask = r["input_ids"], r["mask"]
        assert len(ids) == len(mask) == L * N + 2
        assert (ids[0], ids[-1], mask[0], mask[-1]) == (1, 2, -1, -1)
        events = [ids[1 + i * N:1 + (i + 1) * N] for i in range(L)]
        columns = [mask[1 + i * N:1 + (i + 1) * N] for i in range(L)]
        for i, (e, c) in enumerate(zip(events, columns)):
            real = i < r["n_rows"]
            assert (e[-1] == row_id and 0 not in e and c == list(range(N))) if real else (set(e) == {0} and set(c) == {-1})
    assert sum(r["n_rows"] for r in rows) == prepared[0].count()


def test_same_result_for_any_partitioning(spark, prepared, seqs):
    events, encoder = prepared
    want = sorted(map(repr, seqs.collect()))
    for n in (1, 8):
        assert sorted(map(repr, sequence_table(events.repartition(n), encoder, L).collect())) == want


def test_cut_hot_entities_give_the_same_sequences(spark, monkeypatch, seqs):
    monkeypatch.setattr(layout, "SPLIT_ROWS", 60)
    raw = spark.read.parquet(f"{SF}/events.parquet")
    events = ACTIVITY.normalise(raw)
    assert layout.EntityLayout.fit(events, ["user_id"], ACTIVITY.schema.order).is_split
    cut = sequence_table(events, Encoder.fit(events, ACTIVITY.schema), L)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, seqs.collect()))


def test_shuffled_rows_keep_their_cells(prepared, seqs):
    plain = {(r["user_id"], r["seq_idx"]): r for r in seqs.collect()}
    out = sequence_table(*prepared, L, randomize=True).collect()
    moved = 0
    for r in out:
        p = plain[(r["user_id"], r["seq_idx"])]
        for i in range(r["n_rows"]):
            a, b = 1 + i * N, 1 + (i + 1) * N
            assert sorted(zip(r["mask"][a:b], r["input_ids"][a:b])) == list(zip(p["mask"][a:b], p["input_ids"][a:b]))
            assert r["mask"][b - 2:b] == [N - 2, N - 1]
            moved += r["mask"][a:b] != p["mask"][a:b]
    assert moved > len(out)
    other = sequence_table(*prepared, L, randomize=True, epoch=1).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, out))


def test_pinned_label_is_at_its_place(prepared):
    for r in sequence_table(*prepared, L, randomize=True, fixed=0, label="event_type", moved_to=2).collect():
        for i in range(r["n_rows"]):
            row = r["mask"][1 + i * N:1 + (i + 1) * N]
            assert row[2] == N - 2 and row[-1] == N - 1 and sorted(row) == list(range(N))


def test_next_token_labels(spark):
    row = spark.range(1).select(
        sequence.next_token_labels(F.array(*map(F.lit, [1, 7, 0, 2]))), sequence.same_length_labels(F.array(F.lit(0), F.lit(3))),
        sequence.attention(F.array(F.lit(0), F.lit(3)))).first()
    assert row == ([7, -100, 2], [-100, 3], [0, 1])


def test_chunks_of_23_events(spark):
    df = spark.createDataFrame([("u", i + 1, [i + 10, 5]) for i in range(23)], "u string, pos bigint, input_ids array<int>")
    rows = sequence.sequences(df, "u", 10, 2, bos=None, eos=None).orderBy("seq_idx").collect()
    assert [r["n_rows"] for r in rows] == [10, 10, 3]
    assert rows[2]["input_ids"][0] == 0 and rows[2]["input_ids"][7:] == [0] * 15


def test_mlm_masking(seqs):
    rows = masking.masked_tokens(seqs.withColumn("old", F.col("input_ids")), ["user_id", "seq_idx"], 200, 42).collect()
    chosen = kept = masked = ordinary = 0
    for r in rows:
        for old, new, label in zip(r["old"], r["input_ids"], r["labels"]):
            ordinary += old >= 5
            if label == -100:
                assert new == old
            else:
                assert label == old >= 5 and (new in (old, 3) or 0 <= new < 200)
                chosen, kept, masked = chosen + 1, kept + (new == old), masked + (new == 3)
    assert 0.12 < chosen / ordinary < 0.18 and 0.7 < masked / chosen < 0.9 and 0.03 < kept / chosen < 0.2


@pytest.mark.parametrize("all_,each", [(1.0, 0.0), (0.0, 1.0), (0.25, 0.5), (0.0, 0.0)])
def test_label_masking(seqs, all_, each):
    label = ACTIVITY.schema.label_position()
    rows = masking.masked_labels(seqs.withColumn("old", F.col("input_ids")), ["user_id", "seq_idx"], label, N, 42, all_, each).collect()
    kinds = set()
    for r in rows:
        changed = [i for i, (a, b) in enumerate(zip(r["old"], r["input_ids"])) if a != b]
        assert all(r["mask"][i] == label and r["input_ids"][i] == 3 for i in changed)
        assert len(changed) == r["n_masked"]
        kinds.add("all" if r["n_masked"] == r["n_rows"] else "some" if r["n_masked"] else "none")
    if (all_, each) == (1.0, 0.0):
        assert kinds == {"all"}
    elif (all_, each) == (0.0, 1.0):
        assert "some" in kinds and "all" not in kinds
    elif all_ == 0.0:
        assert kinds == {"none"}
    else:
        assert kinds == {"all", "some", "none"}


def test_one_label_is_never_partly_masked(spark):
    df = spark.createDataFrame([(i, 1, [1, 9, 5, 0, 0, 2], [-1, 0, 1, -1, -1, -1]) for i in range(30)],
                               "u int, n_rows int, input_ids array<int>, mask array<int>")
    out = masking.masked_labels(df, ["u"], 0, 2, 1, 0.0, 1.0).collect()
    assert all(r["n_masked"] == 0 and r["input_ids"] == [1, 9, 5, 0, 0, 2] for r in out)


def test_target_positions(spark):
    df = spark.createDataFrame([([-1, 0, 1, 0, 1, -1],)], "mask array<int>")
    got = {m: masking.target_positions(df, 0, m).first()["positions"] for m in ("all", "labels", "last")}
    assert got == {"all": [0, 1, 2, 3, 4, 5], "labels": [1, 3], "last": [3]}


@pytest.mark.parametrize("n,share,k", [(1, 0.1, 1), (9, 0.1, 1), (40, 0.25, 10), (500, 0.1, 50)])
def test_split_is_exact_disjoint_and_stable(spark, n, share, k):
    df = spark.createDataFrame([(i % n, i) for i in range(2 * n)], "u int, e int")
    fitted = HashSplit.fit(df, ["u"], share, 7)
    tagged = fitted.transform(df)
    assert tagged.where("split = 'test'").select("u").distinct().count() == k
    assert tagged.groupBy("u").agg(F.count_distinct("split").alias("s")).where("s > 1").count() == 0
    again = HashSplit.fit(df.repartition(5), ["u"], share, 7)
    assert again.cutoff == fitted.cutoff
    manifest = fitted.manifest(df)
    assert restore_split(df, manifest, ["u"]).count() == 2 * k and restore_split(df, manifest, ["u"], dryrun=True).count() == 2 * n


def test_shared_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "u int"), spark.createDataFrame([(2,), (2,), (3,)], "u int")
    assert sorted(tuple(r) for r in shared_keys(a, b, "u").collect()) == [(2, "both"), (3, "test_only")]


def test_vocabulary_order_size_and_underscores(spark):
    df = spark.createDataFrame([(["0_b", "1_x_y", "[ROW]"],), (["0_a", "1_x_y", "[ROW]"],)], "t array<string>")
    rows = tokens.fit_vocabulary(df, F.col("t")).orderBy("id").collect()
    assert [r["token"] for r in rows] == ["[PAD]", "[BOS]", "[EOS]", "[MASK]", "[UNK]", "1_x_y", "[ROW]", "0_a", "0_b"]
    assert [(r["col_id"], r["value"]) for r in rows if r["token"] == "1_x_y"] == [(1, "x_y")]
    assert tokens.fit_vocabulary(df, F.col("t"), 7).count() == 7


def test_column_vocabulary_has_no_limit(spark):
    n = 70_000
    rows = tokens.fit_column_vocabulary(spark.range(n).select(F.col("id").alias("v")), ["v"]).orderBy("id").toPandas()
    assert list(rows["id"]) == list(range(n + 4))
    assert list(rows["token"][4:]) == sorted(map(str, range(n)))


def test_decode_and_unknown(spark):
    df = spark.createDataFrame([(["0_b"],)], "t array<string>")
    vocab = tokens.fit_vocabulary(df, F.col("t"))
    coded = spark.createDataFrame([(1, [5, 99, 4])], "k int, input_ids array<int>")
    assert tokens.decode_ids(coded, vocab, ["k"]).first()["tokens"] == ["0_b", "[UNK]", "[UNK]"]
    rows = spark.createDataFrame([("0_b",), ("0_zzz",)], "c string")
    assert [r["input_ids"] for r in tokens.encode_rows(rows, ["c"], vocab).collect()] == [[5, 4], [4, 4]]
