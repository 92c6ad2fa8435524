"""The content sort: hot texts, long texts and texts that only begin alike, against plain Python."""

import collections
import random

import pytest

from banstream.llm import exact_dedup
from banstream.llm.exact_dedup import drop_exact_copies, exact_groups


@pytest.mark.parametrize("keep", ["min", "max"])
def test_hot_texts_are_split_and_meet_again(spark, monkeypatch, keep):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 30)
    draw = random.Random(1)
    head = "the same long beginning of every one of these many texts, " * 2
    texts = ["Hot one"] * 300 + ["hot TWO" + "x" * 5000] * 150 + [None] * 40 + [""] * 30 + [head + str(i % 90) for i in range(400)] + ["é" * 3_000_000, "É" * 3_000_000, "é" * 3_000_000]
    draw.shuffle(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y"), (None, "hot one", "z"), (None, "alone", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _norm string").repartition(5)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    best = {t: (min if keep == "min" else max)((i for i in own if i is not None), default=None) for t, own in groups.items()}
    want = collections.Counter((i, best[lower(t)], len(groups[lower(t)])) for i, t, _ in rows)
    got = exact_groups(df, keep=keep).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == sorted(map(str, best.values()))
    kept = drop_exact_copies(df, keep=keep)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, best.values()))
