"""Subword ids, dictionaries that grow over batches, and labelling that goes on after a crash."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riskloom.operators import labelling, subwords
from riskloom.operators.codebook import CodeBook
from riskloom.operators.encode import first_seen_codes

SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]


def brute_word(word, ids):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in ids:
                out.append(ids[piece])
                at = end
                break
        else:
            return [ids["[UNK]"]]
    return out


def test_longest_pieces_of_random_words():
    draw = random.Random(3)
    for _ in range(200):
        pieces = {"".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(6)} | {"##" + "".join(draw.choices("abc", k=draw.randint(1, 3))) for _ in range(6)}
        ids = {p: i for i, p in enumerate([*SPECIAL, *sorted(pieces)])}
        encoder = subwords.Pieces(ids)
        for _ in range(20):
            word = "".join(draw.choices("abc", k=draw.randint(1, 9)))
            assert encoder.word(word) == brute_word(word, ids)


def test_words_and_truncation():
    assert subwords.split_words("  Héllo, WORLD!\tit's 3.5€\n\x00中文x") == ["hello", ",", "world", "!", "it", "'", "s", "3", ".", "5€", "中", "文", "x"]
    assert subwords.split_words("É", lower=False) == ["É"]
    ids = {p: i for i, p in enumerate([*SPECIAL, "un", "##aff", "##able", "a", "#", "##"])}
    encoder = subwords.Pieces(ids)
    assert encoder.encode("Unaffable a z") == [2, 4, 5, 6, 7, 1, 3]
    assert encoder.encode("unaffable a", max_length=4) == [2, 4, 5, 3]
    assert encoder.encode("unaffable a", max_length=2, special=False) == [4, 5]
    assert encoder.encode("", special=True) == [2, 3] and encoder.encode("a" * 101) == [2, 1, 3]
    with pytest.raises(ValueError):
        subwords.Pieces({"a": 0})


def test_subword_chunks(spark, tmp_path):
    path = subwords.write_pieces(spark, [*SPECIAL, "a", "b", "##b"], str(tmp_path / "pieces"))
    vocabulary = subwords.read_pieces(spark, path)
    df = spark.createDataFrame([(1, ["a bb", " ", None, "b"]), (2, None), (3, [])], "id int, chunks array<string>")
    rows = {r.id: r.encoded for r in subwords.subword_chunks(df, F.col("chunks"), vocabulary, max_length=6, pad=True).collect()}
    assert rows[2] is None and rows[3] == []
    assert [(e.input_ids, e.attention_mask) for e in rows[1]] == [([2, 4, 5, 6, 3, 0], [1, 1, 1, 1, 1, 0]), ([2, 5, 3, 0, 0, 0], [1, 1, 1, 0, 0, 0])]


def test_codes_grow_as_in_one_run(spark, tmp_path):
    rows = [(i, f"v{(i * 7919) % 97 % (i // 20 + 5)}" if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v string")
    book = CodeBook(spark, str(tmp_path / "codes"))
    assert book.codes().collect() == []
    batches = [df.filter((F.col("i") >= a) & (F.col("i") < a + 100)) for a in (0, 100, 200)]
    for n in (0, 1, 1, 2, 0):  # the second comes twice, the first again at the end
        book.extend(batches[n], n, "v", "i")
    # a batch that was not written to its end is written anew
    (tmp_path / "codes" / "batch=000000000002" / "_SUCCESS").unlink()
    book.extend(batches[2], 2, "v", "i")
    want = {(r["key"], r.code) for r in first_seen_codes(df, "v", "i").collect()}
    assert {(r["key"], r.code) for r in book.codes().collect()} == want


def test_codes_follow_a_stream(spark, tmp_path):
    source = str(tmp_path / "rows")
    book = CodeBook(spark, str(tmp_path / "codes"))
    for values in (["b", "a"], ["a", "c"]):
        start = spark.read.schema("i long, v string").parquet(source).count() if (tmp_path / "rows").exists() else 0
        spark.createDataFrame([(start + k, v) for k, v in enumerate(values)], "i long, v string").coalesce(1).write.mode("append").parquet(source)
        book.follow(spark.readStream.schema("i long, v string").parquet(source), "v", "i", str(tmp_path / "mark"))
    assert {(r["key"], r.code) for r in book.codes().collect()} == {("b", 0), ("a", 1), ("c", 2)}


def test_labelling_goes_on_after_a_crash(spark, tmp_path):
    source, out, mark, calls = (str(tmp_path / n) for n in ("cases", "out", "mark", "calls"))
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(4)], "id int").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in the order of their times

    def labeller(crash):
        def label(case):
            with open(calls, "a") as f:
                f.write(f"{case['id']}\n")
            if crash and case["id"] == 12:
                raise SystemExit("lost")
            return {"category": "TrueDNR", "confidence_score": 0.5}

        return label

    def start(crash):
        stream = spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).parquet(source)
        return labelling.label_arriving(stream, out, mark, labeller(crash))

    with pytest.raises(Exception):
        start(True)
    done = start(False)
    assert sorted(r.id for r in done.collect()) == sorted(10 * k + i for k in range(3) for i in range(4))
    called = [int(x) for x in open(calls)]
    assert all(called.count(i) == 1 for i in (*range(4), *range(20, 24))) and called.count(12) >= 2


def test_calls_are_paced():
    waits = []
    wait = labelling._pacer(10.0, waits.append)
    for _ in range(4):
        wait()
    assert len(waits) == 3 and 0.25 < waits[-1] <= 0.3
    labelling._pacer(None, waits.append)()
    assert len(waits) == 3
