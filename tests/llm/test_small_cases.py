"""Nulls, empty tables, repeats, clashing columns and brute force, on small fixtures."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from banstream.llm import queries
from banstream.llm.byte_bpe import Utf8Stream, decode_stream, encode_documents, encode_texts
from banstream.llm.exact_dedup import drop_exact_copies, exact_groups
from banstream.llm.fingerprints import edited, fingerprint_with_edits
from banstream.llm.language_id import identify
from banstream.llm.mixing import mix_sources
from banstream.llm.near_dedup import near_duplicates
from banstream.llm.passage_dedup import repeated_passages
from banstream.llm.token_counts import count_tokens
from banstream.llm.token_files import pack, stored_tokens, unpack
from banstream.llm.url_filter import judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _id int"


def frame(spark, rows):
    """Rows (doc_id, text) with languages, sources and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 3 else "ed"[(i or 0) % 2] + "n", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", len(t or ""), 7, True, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefgéß") for _ in range(random.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    out = [text(random.randint(1, 150)) for _ in range(60)]
    passage = text(60)
    out += [t.upper() for t in out[:4]] + [out[5].replace(" ", "\n", 2), out[5] + " tail"]
    base = text(80).split()
    for _ in range(25):  # one group of near copies
        copy = list(base)
        for _ in range(random.randint(0, 7)):
            copy[random.randrange(80)] = random.choice(vocabulary)
        out.append(" ".join(copy))
    out += [f"{text(20)} {passage} {text(15)}" for _ in range(4)]
    out += [None, "", " \t", "a", "A", "x y", "X Y", "<|endoftext|> and <s>", "é" * 3000, "12 ... !!", "w " * 3000, "\0 nul\0"]
    listed = list(enumerate(out))
    return [*listed, listed[7], listed[8], (None, out[9]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).where(F.lit(False))


def test_exact_groups(docs, rows, none):
    norm = lambda t: (t or "").translate(LOWER)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_groups(docs, keep="max").collect()
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == max((i for i in own if i is not None), default=None) and r["group_size"] == len(own)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_mixing(docs, rows, none):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {(r["doc_id"], r["size"]) for r in got}
    assert sizes == {(i, len(WORD.findall(t or ""))) for i, t in rows}
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["target"]].append(r)
    assert sum(t for t in by) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for target, own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= 0.05 * target + 20
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    assert mix_sources(none).count() == 0


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    for bits in (1, 7, 16, 17, 31):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
        assert (unpack(pack(ids, bits), bits)[:1000] == ids).all()
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in stored_tokens(spark, docs, path).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == want
    assert stored_tokens(spark, none, path).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(docs, rows, none, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, path, limit=50).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), n := count(t or ""), n > 50) for i, t in rows)
    assert count_tokens(none, path).count() == 0


def test_byte_bpe(docs, rows, none):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = [*(t or "" for _, t in rows), "a" * 3000, "ab" * 900, "don't  stop\n\n now", "日本語😀"]
    ids = [x.tolist() for x in encode_texts(odd, path, pattern)]
    assert ids == [own.encode_ordinary(t) for t in odd]
    for t, x in zip(odd, ids, strict=True):
        parts = list(decode_stream((x[i : i + 3] for i in range(0, len(x), 3)), path, pattern))
        assert "".join(p for _, p in parts) == t and b"".join(b for b, _ in parts) == t.encode()
    got = encode_documents(docs, path, pattern, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t in rows)
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)
    assert encode_documents(none, path, pattern).count() == 0


def test_utf8_stream_splits_anywhere():
    data = "aé中😀".encode() + b"\xff\xe4\xb8" + b"z"
    for cut in range(len(data) + 1):
        s = Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.close() == data.decode(errors="replace")


def test_fingerprints(docs, rows, none):
    got = fingerprint_with_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    listed = sorted({i: t or "" for i, t in rows if i is not None}.items())
    texts = dict(listed)
    after = {i: listed[(k + 1) % len(listed)][1] for k, (i, _) in enumerate(listed)}
    terms = lambda t: collections.Counter(tuple(w[i : i + 5]) for w in [WORD.findall(t.translate(LOWER))] for i in range(max(len(w) - 4, 1)) if w)
    prints = collections.defaultdict(set)
    errors = []
    for r in got:
        t, changed = texts[r["doc_id"]], edited(texts[r["doc_id"]], after[r["doc_id"]])
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        prints[t].add(r["fingerprint"])
        a, b = terms(t), terms(changed)
        if a and b:
            errors.append(r["near_edited"] - (a & b).total() / (a | b).total())
    assert len(got) == len(listed) and all(len(p) == 1 for p in prints.values())
    assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.35  # a group of near copies errs together
    assert fingerprint_with_edits(docs).count() == len(rows)
    assert fingerprint_with_edits(none).count() == 0


def test_near_duplicates(docs, rows, none):
    for size in (2, 5):
        sets = {}
        for i, t in rows:
            w = WORD.findall((t or "").translate(LOWER))
            sets.setdefault(i, frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset())
        ids = sorted(i for i in sets if i is not None)
        root = {i: i for i in ids}
        find = lambda x: x if root[x] == x else find(root[x])
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = near_duplicates(docs, size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_duplicates(none).count() == 0


def test_passages(docs, rows, none):
    runs = collections.defaultdict(set)
    short = collections.defaultdict(set)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        for n, into in ((50, runs), (20, short)):
            for k in range(len(w) - n + 1):
                into[tuple(w[k : k + n])].add(i)
    again = lambda s: {i for own in s.values() for i in own if i is not None and i != min(x for x in own if x is not None)}
    found = {r["doc_id"] for r in repeated_passages(docs).collect()}
    assert again(runs) <= found <= again(short)
    assert repeated_passages(none).count() == 0


def test_language_id(spark, docs, rows, none):
    sets = {"en": "the and with this from which their", "fr": "le les des dans pour avec sont", "de": "der und nicht eine über wird auch"}
    random.seed(2)
    made = [(i, " ".join(random.choices(sets[k].split(), k=random.randint(3, 30))), k) for i in range(400) for k in [list(sets)[i % 3]]]
    made += [(1000, None, "en"), (1001, "", None), (1002, "12 !", "fr"), (1003, "der die das über nicht", None)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "de"
    held = [(got[i]["lang_pred"], k) for i, _, k in made[:400] if got[i]["held_out"]]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify(docs).count() == len(rows) and identify(none).count() == 0


def test_urls(spark):
    urls = [None, "", "x", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://notexample.org/en/1", "http://org", "http://com/fr/", "ftp://a.com/de/#x", "http://a..org/x://y", "http://x.net/\n/de/", "http://exämple.org:80/de/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, html string, host int")
    rules = {**dict.fromkeys(queries.ALLOW_RULES, "allow"), **dict.fromkeys(queries.BLOCK_RULES, "block")}

    def want(u):
        head, sep, rest = (u or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", rest if sep else "", re.S)
        host, path = m[1].translate(LOWER), m[2]
        fits = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        return host, path, rule, rules.get(rule, "allow")

    for bits in (1 << 22, 1):  # the cascade, and the join that stands in for it beyond its limit
        got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, queries.ALLOW_RULES, queries.BLOCK_RULES, max_bits=bits).collect()}
        assert got == {i: want(u) for i, u in enumerate([*urls, urls[4]])}
    assert judge_urls(pages.where(F.lit(False)), ["org/"], []).count() == 0
    assert judge_urls(pages, [], []).where("rule is not null").count() == 0


def test_pipeline_stages(spark, docs, none):
    for start in (docs, none):
        step = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, "")
            assert step.columns == start.columns, name
            step = spark.createDataFrame(step.collect(), start.schema)
        assert stage is not None and (step.count() > 0) == (start is docs)
        assert corpus_pipeline.STAGES[-1][1](spark, step, "").count() == step.count()
