"""Readers, writers, fitted tables and streams on small folders."""

import gzip
import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.functions.dialogue import dialogue_chunk
from riskloom.operators import scoring
from riskloom.operators.model import eval_feature_frame, fit_features
from riskloom.operators.quality import RoleSpec
from riskloom.sources import artifacts, readers, shards, writers
from riskloom.streaming import score as st


def test_shards_of_three_formats(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "part-2.json").write_text('{"a": 2, "c": 0.5}\n')
    (tmp_path / "other.csv").write_text("a,b\n9,z\n")
    spark.createDataFrame([(3, "y")], "a int, b string").write.mode("append").parquet(str(tmp_path))
    rows = {r.a: (r.b, r.c) for r in readers.scan_shards(spark, str(tmp_path)).collect()}
    assert rows == {1: ("x", None), 2: (None, 0.5), 3: ("y", None)}
    given = {"csv": "a int, b string", "json": "a int, c double", "parquet": "a int, b string"}
    assert sorted(map(str, readers.scan_shards(spark, str(tmp_path), schemas=given).collect())) == sorted(
        map(str, readers.scan_shards(spark, str(tmp_path)).selectExpr("int(a) a", "b", "c").collect())
    )


def test_no_shards_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.scan_shards(spark, str(tmp_path))


def test_json_array_file_is_flattened(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[\n{"id": 1, "u": {"n": {"k": 5}}},\n{"id": 2}]')
    df = readers.scan_json(spark, str(path), multi_line=True)
    assert df.columns == ["id", "u.n.k"]
    assert sorted((r[0], r[1]) for r in df.collect()) == [(1, 5), (2, None)]
    renamed = readers.restore_dots(spark.createDataFrame([(1,)], "a__DOT__b int"))
    assert renamed.columns == ["a.b"]


def test_role_typed_and_cases(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("h1,h2\nA,1.5\nB,\n")
    roles = RoleSpec(label="y", categorical=("c",), numeric=("n",))
    df = readers.scan_role_typed(spark, str(path), roles, names=["c", "n"])
    assert [tuple(r) for r in df.collect()] == [("A", 1.5), ("B", None)]
    with pytest.raises(ValueError):
        readers.scan_role_typed(spark, "x.xls", roles)
    with pytest.raises(ValueError):
        readers.scan_cases(spark, "x.txt")


def test_merge_batches_reads_each_file_once(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, e array<string>")
    writers.sink_batch_partitioned(df, str(tmp_path), "0")
    writers.sink_batch_partitioned(df, str(tmp_path), "old")
    rows = writers.merge_batches(spark, str(tmp_path), exclude="old").collect()
    assert sorted((r.id, r.e) for r in rows) == [(1, "a;b"), (2, "")]


def test_merge_batches_keeps_partition_columns(spark, tmp_path):
    """The root has the excluded word in its name; one batch is partitioned, one is not."""
    root = str(tmp_path / "batch_old")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, cat string")
    writers.sink_batch_partitioned(df, root, "0", ["cat"])
    writers.sink_batch_partitioned(df.filter("id = 2"), root, "1")
    writers.sink_batch_partitioned(df, root, "old_2")
    merged = writers.merge_batches(spark, root, exclude="old", to=str(tmp_path / "merged"), partition_cols=["cat"], compression="zstd")
    assert sorted((r.id, r.cat) for r in merged.collect()) == [(1, "x"), (2, "y"), (2, "y")]
    with pytest.raises(ValueError):
        writers.merge_batches(spark, root, exclude="batch")


def test_metrics_beyond_exact_numbers(spark, tmp_path):
    row = spark.createDataFrame([(3e15, None, float("nan"), -0.62645)], "big double, none double, nan double, small double")
    writers.sink_metrics(row, str(tmp_path / "m"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "m" / "metrics.txt")).collect())
    assert lines == ["big: 3000000000000000.0000", "nan: nan", "none: NULL", "small: -0.6264"]


def test_artifacts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 0), ("b", 3.0, 1)], "c string, n double, y int")
    state = fit_features(df, "y", ["c"], ["n"])
    artifacts.save_features(spark, state, str(tmp_path))
    loaded = artifacts.load_features(spark, str(tmp_path))
    want = sorted(tuple(r) for r in eval_feature_frame(df, state, ["y"]).collect())
    got = sorted(tuple(r) for r in eval_feature_frame(df, loaded, ["y"]).collect())
    assert got == want and loaded.order == ["n", "c"]
    with pytest.raises(ValueError):
        artifacts.check(df, "bins")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, ["A b", "c"]), (2, ["d"])], "id int, m array<string>")
    source = str(tmp_path / "in")
    df.write.parquet(source)
    chain = lambda rows: st.stream_dialogue(rows, ["id"], F.col("m"), 2)
    streamed = st.replay(spark, source, df.schema, chain)
    assert sorted(tuple(r) for r in streamed.collect()) == sorted(tuple(r) for r in chain(df).collect())
    assert streamed.count() == 3
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("*.parquet")
    assert st.replay(spark, str(part), df.schema, chain).count() == 3
    assert df.select(F.size(dialogue_chunk(F.col("m"), 2))).count() == 2


def test_stream_restart_adds_only_new_files(spark, tmp_path):
    schema = "id int"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i in range(2):
        spark.createDataFrame([(i,)], schema).coalesce(1).write.mode("append").parquet(source)
        st.run_available(spark.readStream.schema(schema).parquet(source), out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1]


def test_separators_are_found_per_shard(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text('a,b\n1,"x;y;z"\n')
    (tmp_path / "part-2.tsv").write_text("a\tb\n2\tx,y\n")
    (tmp_path / "part-3.csv").write_text("b;a\nq;3\n")
    (tmp_path / "part-4.csv").write_text("a|b|c\n4|w|0.5\n")
    (tmp_path / "part 5.csv").write_text("a,b\n9,other name\n")
    (tmp_path / "part-6 x%20.csv").write_text("a,b\n6,blank\n")
    (tmp_path / "part-7.csv").write_text("")
    (tmp_path / "part-8.csv").write_text("a\n8\n")
    with gzip.open(tmp_path / "part-9.tsv.gz", "wt") as f:
        f.write("a\tb\n9\tpacked\n")
    (tmp_path / "part-a.json").write_text('{"a": 10, "b": "j"}\n{"a": 11}\n')
    (tmp_path / "part-b.json").write_text('[\n{"a": 12, "b": "k"}\n]')
    rows = {r.a: (r.b, r.c) for r in readers.scan_shards(spark, str(tmp_path)).collect()}
    assert rows == {
        1: ("x;y;z", None), 2: ("x,y", None), 3: ("q", None), 4: ("w", 0.5), 6: ("blank", None), 8: (None, None),
        9: ("packed", None), 10: ("j", None), 11: (None, None), 12: ("k", None),
    }


def test_separator_rules():
    assert shards.detect_separator(['a;b,c;d', '"1;2";3,5;4']) == ";"
    assert shards.detect_separator(["a:b:c|d", "1:2|3"]) == "|"
    assert shards.detect_separator(["alone"]) == shards.detect_separator([]) == ","
    assert shards.detect_separator(["a\tb", "1\t2\t3"]) == "\t"
    assert shards.detect_json(['{"a": 1}']) == "lines" and shards.detect_json(["{", '"a": 1}']) == shards.detect_json(["[{}]"]) == "whole"


def test_heads_read_the_first_lines_only(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"part-{i}.csv").write_text(f"a{i},b\n1,2\n" + "3,4\n" * (400_000 if i == 0 else 3))
    found = shards.heads(spark, str(tmp_path), "part-*.csv")
    assert len(found) == 12 and all(len(v) == 2 and v[1] == "1,2" for v in found.values())
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 61)


def test_wrapped_parquet(spark, tmp_path):
    def wrap(name, columns):
        buffer = io.BytesIO()
        pq.write_table(pa.table(columns), buffer)
        (tmp_path / name).write_bytes(gzip.compress(buffer.getvalue()))

    for i in range(8):
        wrap(f"part-{i}.parquet.gz", {"a": pa.array([i, i + 100], pa.int32()), "s": pa.array(["x", None]).dictionary_encode()})
    wrap("part-8.parquet.gz", {"s": pa.array([], pa.string()), "a": pa.array([], pa.int32())})
    wrap("part-9.parquet.gz", {"a": pa.array([9], pa.int64()), "l": pa.array([[1.5, None]], pa.list_(pa.float64())), "u": pa.array([7], pa.uint32())})
    (tmp_path / "part-x.csv").write_text("a,s\n50,y\n")
    spark.createDataFrame([(60, "z")], "a int, s string").write.mode("append").parquet(str(tmp_path))
    df = readers.scan_shards(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "s": "string", "l": "array<double>", "u": "bigint"}
    rows = {r.a: (r.s, r.l, r.u) for r in df.collect()}
    assert rows == {**{i: ("x", None, None) for i in range(8)}, **{i + 100: (None, None, None) for i in range(8)}, 9: (None, [1.5, None], 7), 50: ("y", None, None), 60: ("z", None, None)}
    given = readers.scan_shards(spark, str(tmp_path), schemas={"csv": "a int, s string", "parquet": "a long, s string"})
    assert given.columns == ["a", "s"] and given.count() == 19


def test_merge_batches_types_partition_values_over_all_batches(spark, tmp_path):
    root = str(tmp_path / "k=v")
    df = spark.createDataFrame([(1, 7, "a b:c/d+%"), (2, None, None), (3, 8, "z")], "id int, n int, s string")
    writers.sink_batch_partitioned(df, root, "0", ["n", "s"])
    writers.sink_batch_partitioned(df, root, "1", ["n"])
    merged = writers.merge_batches(spark, root)
    assert str(merged._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    assert merged.schema["n"].dataType.simpleString() == "int"
    assert sorted(map(str, ((r.id, r.n, r.s) for r in merged.collect()))) == sorted(2 * [str((1, 7, "a b:c/d+%")), str((2, None, None)), str((3, 8, "z"))])


def test_a_column_without_numbers_still_scores(spark):
    df = spark.createDataFrame([("u", 1.0, None, 1), ("v", 2.0, None, 0)] * 5, "cat string, a double, b double, y int")
    state = fit_features(df, "y", ["cat"], ["a", "b"])
    fills, defaults = scoring.literals(state)
    assert "b" not in fills
    assert {r.b for r in scoring.literal_features(df, state, fills, defaults).collect()} == {0.0}
