"""Suffix arrays by linear grouping against sorting, and the removal of repeated substrings against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from banstream.llm import suffix_dedup
from banstream.llm.suffix_dedup import repeated_substrings
from banstream.llm.suffix_groups import suffix_array, suffix_arrays


def test_suffix_arrays():
    draw = random.Random(1)
    texts = [bytes(draw.randrange(k) for _ in range(draw.randint(0, 40))) for k in (1, 2, 3, 256) for _ in range(100)]
    texts += [t[: max(1, len(t) // 4)] * 5 for t in texts[:200]] + [b"\xff" * 70, bytes(range(256))]
    order = lambda t: sorted(range(len(t)), key=lambda i: t[i:])
    assert all(suffix_array(t).tolist() == order(t) for t in texts)
    letters = [[300, *(b + 1 for b in t), 0] for t in texts]  # all side by side, each behind a guard
    sizes = np.array([len(x) - 1 for x in letters])
    firsts = np.cumsum(sizes + 1) - sizes
    got = suffix_arrays(np.concatenate(letters), firsts, sizes)
    assert all((got[f + 1 : f + n] - f).tolist() == order(t) for f, n, t in zip(firsts, sizes, texts, strict=True))


def brute(rows, length=50):
    """{(id, text): (spans, kept)}."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], []).append(i)
    last = float("inf")
    least = {s: min(last if i is None else i for i in own) for s, own in first.items()}
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for k in range(len(raw) - length + 1):
            if least[raw[k : k + length]] < (last if i is None else i):
                gone[1 + k : 1 + k + length] = 1
        turns = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        out[i, t or ""] = ([tuple(x) for x in turns.tolist()], bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g))
    return out


def documents(draw):
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    common = [word() for _ in range(60)]
    text = lambda n: " ".join(draw.choice(common) for _ in range(n))
    passages = [text(n) for n in (8, 9, 10, 11, 12, 20, 60)] + ["x" * 49, "y" * 50, "ab" * 40]
    rows = []
    for i in range(150):
        parts = [text(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            parts += [p[draw.randint(0, 5) :], text(draw.randint(0, 12))]
        rows.append((i, draw.choice(["", " "]).join(parts)))
    line = text(14)
    rows += [(200 + i, f"{word()}{word()} {line} {word()}{word()}") for i in range(40)]  # one line everywhere
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(310, "z" * 3000), (311, "z" * 200), (312, rows[5][1] + "!")]
    rows += [(320, None), (321, ""), (322, "a"), (7, rows[9][1]), (7, rows[9][1]), (None, rows[2][1]), (None, rows[2][1] + text(30)), (None, None), (-5, rows[12][1])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "hot_parts", "part"), [(suffix_dedup.HOT, suffix_dedup.HOT_PARTS, suffix_dedup.PART_BYTES), (3, 512, 2000), (1024, 1, 2000), (5, 4, 1000)])
def test_repeated_substrings(spark, monkeypatch, hot, hot_parts, part):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", suffix_dedup.BUCKET_ANCHORS if hot_parts > 4 and hot > 3 else 500)
    rows = documents(random.Random(hot + hot_parts))
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, part int, at string").repartition(3)
    got = repeated_substrings(docs, hot=hot, hot_parts=hot_parts).collect()
    assert len(got) == len(rows)
    found = sorted((str(r["doc_id"]), r["n_bytes"], str([tuple(s) for s in r["spans"]]), bytes(r["kept"])) for r in got)
    assert found == sorted((str(i), len((t or "").encode()), str(want[i, t or ""][0]), want[i, t or ""][1]) for i, t in rows)


@pytest.mark.parametrize("length", [16, 33, 112])
def test_other_lengths(spark, length):
    rows = documents(random.Random(length))
    want = brute(rows, length)
    got = repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert all([tuple(s) for s in r["spans"]] in [v[0] for (i, _), v in want.items() if i == r["doc_id"]] for r in got)
    assert sorted(bytes(r["kept"]) for r in got) == sorted(want[i, t or ""][1] for i, t in rows)


def test_long_texts_and_none(spark):
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefgh ") for _ in range(2_600_000))  # over several slices
    rows = [(1, long), (2, long[1_048_000:1_049_200] + "#" + long[-300:] + "#" * 60), (3, long)]
    got = {r["doc_id"]: r for r in repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == [] and bytes(got[3]["kept"]) == b"" and [tuple(s) for s in got[2]["spans"]] == [(0, 1200), (1201, 1501)]
    none = spark.createDataFrame(rows, "doc_id long, text string").where(F.lit(False))
    assert repeated_substrings(none).count() == 0


def test_passes_leave_no_shuffle_files(spark):
    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}

    docs = spark.createDataFrame(documents(random.Random(2)), "doc_id long, text string")
    before = shuffled()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting, None)
    out = repeated_substrings(docs, hot=3)
    assert not shuffled() - before and spark.conf.get(setting, None) == kept
    assert out.count() == docs.count()


def test_hot_strings_are_posted_once():
    """Neighbouring anchors have strings in common, and a part has a string in several documents."""
    line = "".join(random.Random(1).choices("abcdefgh ", k=300))
    table = pa.table({"id": [4, 3, 9], "text": [line, line, "#" + line[:200]], "part": [0, 0, 0]})
    ids, data, starts = suffix_dedup._texts(table)
    at, _ = suffix_dedup.anchors(data, starts, 50)
    planes = suffix_dedup._planes
    asked = pa.table({"lane": [planes(np.ones(len(at)), 8)], "hot": [bytes([1] * len(at))], "n": [planes(np.ones(len(at)))], "at": [planes(at)]})
    out = suffix_dedup._post_hot(50, 3)(table, asked)
    least = suffix_dedup._unplaned(out, "least", 8)
    want = {}
    for i, text in zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True):
        for k in range(len(text) - 49):
            want[text[k : k + 50]] = min(i, want.get(text[k : k + 50], i))
    assert out.num_rows == 3 and sorted(least.tolist()) == sorted(want.values())
