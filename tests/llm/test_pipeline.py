"""The pipeline against brute force, and the recall of its near-duplicate classes."""

import hashlib
import random

import pytest

pytest.importorskip("nodetide.llm")
pytest.importorskip("corpus_pipeline")

from tests_llm_rows import make_rows  # noqa: E402


def write(spark, tmp_path, rows):
    # Columns whose names the stages use themselves.
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else "de", f"src{(i or 0) % 5}", len(t or ""), 7, "x", [1], None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, block int, rows string, ids array<int>, tokens string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs


def classes(n, linked):
    out = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if out[i] != out[j] and linked(i, j):
                    out[i] = out[j] = min(out[i], out[j])
                    changed = True
    return out


def test_wide_classes_and_recall(spark):
    from nodetide.llm import near_texts as w

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    rows, pairs = [], []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        rows.append((2 * i, " ".join(base)))
        near = list(base)
        for _ in range(max(1, len(near) // 60)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append((2 * i + 1, " ".join(near)))
        shingles = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, near)]
        if len(shingles[0] & shingles[1]) >= 0.8 * len(shingles[0] | shingles[1]):
            pairs.append((2 * i, 2 * i + 1))
    got = dict(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(pairs) > 30 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len({got[2 * i] for i in range(60)}) == 60  # nothing else is joined


@pytest.mark.parametrize("small_group,block", [(256, 64), (1, 4)])
def test_classes_against_all_pairs(spark, small_group, block, monkeypatch):
    from nodetide.llm import near_texts as w
    from nodetide.llm import simhash

    monkeypatch.setattr(simhash, "SMALL_GROUP", small_group)
    monkeypatch.setattr(w, "BLOCK", block)
    rows = make_rows() + [(None, make_rows()[3][1]), (None, "nothing like it " * 9)]
    c = classes(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    want = sorted(((i, min((rows[k][0] for k in range(len(rows)) if c[k] == c[n] and rows[k][0] is not None), default=None)) for n, (i, _) in enumerate(rows)), key=str)
    got = sorted(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == want


def test_run(spark, tmp_path):
    import duckdb
    import numpy as np
    import pyarrow as pa

    import corpus_pipeline as P
    import public_tokenizers
    from nodetide.llm import byte_bpe, source_mix
    from test_documents import WORD, repeat_words
    from test_substrings import brute

    rows = make_rows() + [(None, make_rows()[9][1] + " and more of it"), (None, " ".join(f"lone{k}" for k in range(90))), (None, " ".join(f"lone{k}" for k in range(90))), (None, None)]
    docs = write(spark, tmp_path, rows)
    good = []
    for i, t in rows:
        ws, t = WORD.findall(t or ""), t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        adj = sum(a == b for a, b in zip(ws, ws[1:]))
        if len(ws) >= 20 and 100 * repeat_words(ws) <= 30 * len(ws) and (len(lines) - len(set(lines))) * 2 <= len(lines) and adj * 10 <= 3 * len(ws):
            good.append((i, t))
    c = classes(len(good), lambda i, j: jaccard(good[i][1], good[j][1]) >= 0.8)
    one = [min((good[j] for j in range(len(good)) if c[j] == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in sorted(set(c))]
    cut = []
    for (i, t), (_, u, gone) in zip(one, brute(one, lambda t: t.encode(), 50)):
        out, at = [], 0
        for ch in t:
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                out.append(ch)
            at += n
        cut.append((i, "".join(out)))
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": [i for i, _ in cut], "text": [t for _, t in cut], "lang": ["en" if (i or 0) % 3 else "de" for i, _ in cut], "source": [f"src{(i or 0) % 5}" for i, _ in cut]}))
    taken = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({source_mix.oracle_sql(P.MIX)})").fetchall()}
    codec = byte_bpe.Codec(byte_bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want = []
    for i, t in cut:
        if i in taken:
            ids = np.frombuffer(codec.encode(t), "<i4").tolist()
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str) and 10 < len(want) < len(rows)
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns


def test_run_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    write(spark, tmp_path, [])
    assert P.run(spark, str(tmp_path)).collect() == []


def shingle_set(t):
    x = (t or "").encode().lower().split()
    return {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set()


def jaccard(t, u):
    a, b = shingle_set(t), shingle_set(u)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_wide_recall_of_block_edits(spark):
    from nodetide.llm import near_texts as w

    rng = random.Random(10)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for i in range(200):
        base = say(rng.randint(60, 400))
        block = len(base) * (5, 10, 15, 18)[i // 2 % 4] // 100
        at = rng.randrange(len(base) - block)
        near = base + say(block) if i % 2 else base[:at] + base[at + block :]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    pairs = [(2 * i, 2 * i + 1) for i in range(200) if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8]
    got = dict(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(pairs) > 150 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(got[i] // 2 == i // 2 for i in got)


@pytest.mark.parametrize("small_group", [256, 1])
def test_wide_keeps_texts_of_one_frame_apart(spark, small_group, monkeypatch):
    from nodetide.llm import simhash
    from nodetide.llm import near_texts as w

    monkeypatch.setattr(simhash, "SMALL_GROUP", small_group)
    monkeypatch.setattr(w, "BLOCK", 16, raising=False)
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    frame, rows = say(200), []
    for i in range(70):
        rows.append((i, " ".join(frame + say(25 + i % 16))))
    rows += [(i, f"{rows[i - 70][1]} more {i}") for i in range(70, 90)]
    c = classes(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    want = dict(enumerate(c))
    assert 50 < len(set(c)) <= 70
    assert dict(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_wide_checks_shingles(spark):
    from nodetide.llm import near_texts as w

    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    base = [rng.choice(vocab) for _ in range(200)]
    mixed, turned = rng.sample(base, len(base)), base[100:] + base[:100]
    scattered = list(base)
    for k in range(0, 200, 20):
        scattered[k] = base[k + 1]  # the words hardly change, the shingles do
    rows = [(i, " ".join(x)) for i, x in enumerate([base, mixed, turned, scattered, base])]
    assert jaccard(rows[0][1], rows[1][1]) < 0.1 and jaccard(rows[0][1], rows[2][1]) > 0.8 and jaccard(rows[0][1], rows[3][1]) < 0.8
    got = dict(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0}


def test_wide_keeps_a_row_of_each_class_whatever_its_id(spark):
    from nodetide.llm import near_texts as w

    rng = random.Random(13)
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    t = [say() for _ in range(6)]
    # Two texts of id 1 of which one is a copy of id 0's, three of no id, one of them a copy of id 2's.
    rows = [(0, t[0]), (1, t[0]), (1, t[1]), (None, t[2]), (None, t[3]), (None, t[4]), (2, t[4]), (None, t[3]), (3, t[5]), (3, t[5])]
    kept = sorted((tuple(r) for r in w.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(0, t[0]), (1, t[1]), (None, t[2]), (None, t[3]), (2, t[4]), (3, t[5])], key=str)


def test_wide_rows_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    from nodetide.llm import near_texts as w

    monkeypatch.setattr(w, "BLOCK", 8)
    real, made = w._cells, []

    def cells(*a):
        out = real(*a)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(w, "_cells", cells)
    rng = random.Random(14)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    frame = say(100)
    for n in (60, 240):
        made.append(0)
        # Every third text is near the frame, the others have too much of their own.
        rows = [(i, " ".join(frame + say(2 if i % 3 == 0 else 18 + i % 5))) for i in range(n)]
        c = classes(n, lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8) if n == 60 else None
        got = dict(map(tuple, w.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert c is None or got == dict(enumerate(c))
    assert made[1] <= 8 * max(made[0], n)  # 16 times with the square


@pytest.mark.parametrize("bits,block", [(18, 64), (6, 1)])
def test_first_shingles_find_all_pairs(spark, bits, block, monkeypatch):
    import numpy as np

    from nodetide.llm import near_texts as w

    monkeypatch.setattr(w, "BLOCK", block)
    monkeypatch.setattr(w, "BUCKET_BITS", bits)
    rng = np.random.default_rng(15)
    base, sets = rng.integers(0, 1 << 32, 60, np.uint32), []
    for i in range(120):
        own = base[: rng.integers(45, 61)].copy()
        own[rng.random(len(own)) < 0.08] = 0
        sets.append(np.unique(np.concatenate([own[own > 0], rng.integers(0, 1 << 32, rng.integers(0, 5), np.uint32)])))
    sets += [sets[0][:1], sets[0][:1], sets[1][:4], sets[1][:5]]
    root = [i if i % 3 else i % 9 for i in range(len(sets))]
    open_ = spark.createDataFrame([(i, r, 0) for i, r in enumerate(root)], "node long, root long, fp long")
    got = w._first_links(open_, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, s binary").repartition(3))
    near = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and near(sets[i], sets[j])}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want and 100 < len(want) < 6000
