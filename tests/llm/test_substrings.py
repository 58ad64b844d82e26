"""Both substring removals against brute force."""

import hashlib
import random
import re

import pytest

pytest.importorskip("nodetide.llm")

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["the", "en", "ré", "on", "ß", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [(i, say(rng.randint(1, 150))) for i in range(30)]
    shared = [say(n) for n in (52, 60, 110, 12, 9)]
    for i in range(30, 60):
        a, b = rng.choice(shared), rng.choice(shared)
        out.append((rng.choice([i, i + 100]), f"{say(rng.randint(0, 20))} {a} {say(rng.randint(0, 3))}\n{b}{say(2)}"))
    base = out[40][1]
    for i in range(200, 220):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "é" * rng.randint(1, 3)
        out.append((i, " ".join(w)))
    out += [(300, base), (301, base), (301, base), (301, shared[2]), (None, base), (None, None), (302, None), (303, ""), (304, "x" * 49), (305, "x" * 50), (306, "x" * 120), (307, "go " * 400), (308, "go " * 60), (309, " \n "), (1, shared[2])]
    rng.shuffle(out)
    return out


def brute(rs, cells, length):
    least = {}
    for d, t in rs:
        if d is not None:
            u = cells(t)
            for i in range(len(u) - length + 1):
                k = tuple(u[i : i + length])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rs:
        u = cells(t)
        gone = [False] * len(u)
        if d is not None:
            for i in range(len(u) - length + 1):
                if least[tuple(u[i : i + length])] < d:
                    gone[i : i + length] = [True] * length
        out.append((d, u, gone))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000, 400])
def test_suffix_dedup(spark, block_bytes):
    from nodetide.llm import suffix_dedup

    want = []
    for d, u, gone in brute(rows(), lambda t: (t or "").encode(), 50):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(u), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "doc_id long, text string, n_bytes string, block int").repartition(3)
    got = [tuple(r) for r in suffix_dedup.report(docs, block_bytes=block_bytes).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 2000


def test_cut_texts_keeps_columns_and_characters(spark):
    from nodetide.llm import suffix_dedup

    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows()], "doc_id long, text string, size int, `rows` string")
    got = suffix_dedup.cut_texts(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows()) and not any("�" in (r.text or "") for r in out)
    assert suffix_dedup.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes,hot", [(1 << 20, 512), (3000, 2), (400, 1)])
def test_window_dedup(spark, block_bytes, hot):
    from nodetide.llm import window_dedup

    want = []
    for d, u, gone in brute(rows(), lambda t: WORD.findall((t or "").encode()), 50):
        want.append((d, len(u), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "doc_id long, text string, n_words string, block int").repartition(3)
    got = [tuple(r) for r in window_dedup.report(docs, block_bytes=block_bytes, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 500
    assert window_dedup.report(docs.limit(0)).count() == 0


def test_rank_pairs(spark):
    from nodetide.llm import rank_pairs

    want = [(d, len(u), sum(gone)) for d, u, gone in brute(rows(), lambda t: (t or "").encode(), 50)]
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, rank_pairs.report(docs).collect()), key=key) == sorted(want, key=key)
    assert rank_pairs.report(docs.limit(0)).count() == 0
