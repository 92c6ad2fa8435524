"""The whole pipeline against plain Python: what each stage must keep of what the one before it kept."""

import base64
import collections
import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from banstream.llm import language_id, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _copies string, _row int"


def made():
    draw = random.Random(8)
    words = {"en": "the and with this from which their house people water".split(), "fr": "le les des dans pour avec sont maison eau gens".split()}
    fresh = lambda k, n: [draw.choice(words[k]) + draw.choice("abcdefgh") * draw.randint(0, 2) for _ in range(n)]
    out = [(" ".join(fresh("en fr".split()[i % 2], draw.randint(20, 120))), "en fr".split()[i % 2]) for i in range(150)]
    out += [(t.upper(), k) for t, k in out[:10]]
    for t, k in out[20:40]:  # near copies, one word changed
        own = t.split()
        own[len(own) // 2] = "changed"
        out.append((" ".join(own), k))
    out += [(None, "en"), ("", None), ("12 !", "fr"), (" \t", "fr")]
    rows = [(i, t, k if i % 7 else None, [None, "a", "b", "c"][i % 4], len(t or ""), i, "x", 1) for i, (t, k) in enumerate(out)]
    return [*rows, (None, "the people with their water from this house " * 5, "en", "a", 9, 1, None, 2)]


def near(rows, size=5):
    sets = {}
    for r in rows:
        w = WORD.findall(r[1].translate(LOWER))
        sets[r[0]] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) != i}


def test_every_stage_by_brute_force(spark, tmp_path):
    rows = made()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.train(table.where(~language_id.held_out("doc_id")))
    kept = [r for r in rows if r[1] is not None and any(map(str.isalpha, r[1])) and model.scores([r[1]]).max() >= 0.5]
    assert {r[0] for r in rows} - {r[0] for r in kept} <= {180, 181, 182, 183}  # clean documents stay
    best = {}
    for r in kept:
        text = r[1].translate(LOWER)
        if text not in best or (r[0] is not None and (best[text][0] is None or r[0] < best[text][0])):
            best[text] = r
    kept = list(best.values())
    assert len(kept) == 171
    gone = near(kept)
    kept = [r for r in kept if r[0] not in gone]
    assert len(gone) >= 10
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(spark.createDataFrame(kept, SCHEMA)).collect()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = collections.Counter()
    for r in kept:
        ids = own.encode_ordinary(r[1])
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += copies[r[0]]
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
