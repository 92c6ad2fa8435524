"""Cases in which an operator once did less than its whole job."""

import random

import pytest

from banstream.llm.near_dedup import near_duplicates
from banstream.llm.passage_dedup import RUN, WORDS, repeated_passages, tune_bands

SCHEMA = "doc_id long, text string"


def grams(own):
    return {tuple(own[i : i + RUN]) for i in range(len(own) - RUN + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def fresh(draw, n):
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def near_lines(draw):
    """Documents of a short line, a long one and its end: long lines share a common phrase, and half of them are copies with one to three words changed."""
    common, texts = fresh(draw, 8), []
    for _ in range(110):
        own = fresh(draw, draw.randint(20, 60)) + common + fresh(draw, draw.randint(5, 40))
        copy = list(own)
        for at in draw.sample(range(len(own)), draw.randint(1, 3)):
            copy[at] = fresh(draw, 1)[0]
        texts += [(fresh(draw, draw.randint(0, 9)), t, fresh(draw, 5)) for t in (own, copy)]
    draw.shuffle(texts)
    return texts


def test_similar_lines_are_found_whatever_their_bands_hold(spark):
    texts = near_lines(random.Random(5))
    sets = [grams(t) for _, t, _ in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) >= 40
    rows = [(i, "\n".join(" ".join(part) for part in t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).where(f"n_words > {WORDS}").collect()}
    found = [(i, j) for i, j in pairs if j in got and got[j]["kept_doc_id"] == i]
    assert len(found) >= 0.95 * len(pairs)
    runs = [{tuple(t[k : k + WORDS]) for k in range(len(t) - WORDS + 1)} for _, t, _ in texts]
    exact = {j for j in range(len(texts)) if any(runs[i] & runs[j] for i in range(j))}
    assert set(got) <= {j for _, j in pairs} | exact  # nothing else goes
    for _, j in found:  # the whole line and nothing more
        before, own, _ = texts[j]
        assert (got[j]["first_word"], got[j]["n_words"]) == (len(before), len(own))


@pytest.mark.parametrize("n", [50, 61, 140])
def test_passages_inside_lines_are_removed_to_the_word(spark, n):
    draw = random.Random(n)
    passage, rows, want = fresh(draw, n), [], {}
    for i in range(12):
        before, after = fresh(draw, draw.randint(0, 70)), fresh(draw, draw.randint(0, 70))
        own = before + passage + after
        ends = [draw.choice("  \n") for _ in own]  # line feeds anywhere, also inside the passage
        rows.append((i, "".join(w + e for w, e in zip(own, ends, strict=True))))
        want[i] = (len(before), n, 0)
    del want[0]
    rows.append((99, " ".join(fresh(draw, 300))))
    got = {r["doc_id"]: (r["first_word"], r["n_words"], r["kept_doc_id"]) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_bands_are_tuned_for_recall():
    for similarity, recall in ((0.8, 0.95), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = tune_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall


def test_words_that_a_polynomial_would_confuse_stay_apart(spark):
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in morse), "".join("ba"[b] for b in morse)
    got = near_duplicates(spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string"), size=2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]
