"""Document operators against brute force, on a small fixture with awkward rows."""

import hashlib
import random
import re

import pytest

pytest.importorskip("nodetide.llm")

from tests_llm_rows import make_rows  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"src{i % 5}", 7, "clash", 1) for i, t in make_rows()], "doc_id long, text string, lang string, source string, n_chars long, n_words string, tokens int").repartition(5)


def empty(docs):
    return docs.limit(0)


def fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    """Least id reachable of each position."""
    out = list(range(len(nodes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(nodes)):
            for j in range(len(nodes)):
                if linked(nodes[i], nodes[j]) and out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


@pytest.mark.parametrize("small_group", [256, 1])
def test_simhash(docs, small_group, monkeypatch):
    from nodetide.llm import simhash

    monkeypatch.setattr(simhash, "SMALL_GROUP", small_group)
    none = docs.selectExpr("doc_id + 1000 AS doc_id", "text").filter("doc_id IN (1003, 1101)").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    named = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs.select("doc_id", "text").unionByName(none)).collect() if r.doc_id is None}
    assert len(named) == 2 and None not in named.values()  # a row without an id is classed with its copies
    rows = sorted(make_rows(), key=lambda r: r[0])
    f = [fingerprint(t) for _, t in rows]
    c = classes(f, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted((rows[i][0], f"{f[i]:016x}", rows[c[i]][0]) for i in range(len(rows)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("small_group", [256, 8, 1])
def test_pigeonring_links_every_close_pair(spark, small_group, monkeypatch):
    from nodetide.llm import simhash

    monkeypatch.setattr(simhash, "SMALL_GROUP", small_group)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    f = set(base)
    for b in base:
        for _ in range(4):
            f.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    f |= {base[0] ^ sum(1 << rng.randrange(30, 64) for _ in range(rng.randint(1, 4))) for _ in range(60)}  # one large group
    f = sorted(x - (1 << 64) if x >> 63 else x for x in f)
    want = classes(f, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = dict(map(tuple, simhash.components(simhash.links(spark.createDataFrame([(x,) for x in f], "fp long"))).collect()))
    assert [got.get(x, x) for x in f] == [f[i] for i in want]


def test_components_of_chains_stars_and_rings(spark):
    from nodetide.llm import simhash

    rng = random.Random(15)
    names = list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)})
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[i]) for i in range(151, 250)]
    edges += [(names[260 + i], names[260 + (i + 1) % 30]) for i in range(30)] + [(names[rng.randrange(300, 400)], names[rng.randrange(300, 400)]) for _ in range(90)] + [(names[5], names[5])]
    rng.shuffle(edges)
    root = {x: x for x in names}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect()))
    assert {x: got.get(x, x) for x in names} == root
    assert simhash.components(spark.createDataFrame(edges[:0], "a long, b long")).count() == 0


def repeat_words(w):
    n, seen, cover = len(w), {}, set()
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover.update(range(i, i + 8))
    return len(cover)


def test_quality_rules(docs):
    from nodetide.llm import quality_rules

    want = []
    for i, t in make_rows():
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        sym, dup, rep = len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w)
        chars = sum(map(len, w))
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        upper = sum(c.isupper() for c in t)
        adj = sum(a == b for a, b in zip(w, w[1:]))
        kept = not (failed or sym * 10 > 3 * len(w) or upper * 2 > chars or chars > 20 * len(w) or dup * 2 > len(lines) or adj * 10 > 3 * len(w))
        want.append((i, len(w), chars, sym, dup, rep, failed, kept))
    assert sorted(map(tuple, quality_rules.quality_report(docs).collect())) == sorted(want)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r[-1] for r in want)
    assert quality_rules.quality_report(empty(docs)).count() == 0


def test_quality_order_does_not_change_the_verdict(docs):
    import itertools

    from nodetide.llm import quality_rules as q

    awkward = docs.unionByName(docs.limit(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "upper(text) AS text", "lang", "source", "n_chars", "n_words", "tokens"))
    verdict = lambda order: sorted(map(tuple, q.apply_rules(awkward.select("doc_id", "text"), order=list(order)).select("doc_id", "n_words", "kept").collect()), key=str)
    want = verdict(q.RULES)
    assert any(r[0] is None for r in want) and 0 < sum(r[2] for r in want) < len(want)
    for order in [q.RULES[::-1], *itertools.islice(itertools.permutations(q.RULES), 7, 120, 30)]:
        assert verdict(order) == want


def test_quality_plan_puts_rejections_per_cost_first(spark):
    from nodetide.llm import quality_rules as q
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "some words here " * 60) for i in range(300)], "doc_id long, text string")
    never = q.Rule("never", lambda t, w: F.length(t) < 0)
    always = q.Rule("always", lambda t, w: F.length(t) > 0)
    slow = q.Rule("slow", lambda t, w: F.size(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.split(F.concat(t, i.cast("string")), "[ae]"))))) < 0)
    names = [r.name for r in q.plan_cascade(d, (slow, never, always))]
    assert sorted(names) == ["always", "never", "slow"] and names.index("always") < names.index("slow")
    assert [r.name for r in q.plan_cascade(d.limit(0), (slow, never, always))] == ["slow", "never", "always"]


def test_source_mix(docs, spark):
    import duckdb

    from nodetide.llm import source_mix

    duck = duckdb.connect()
    import pyarrow as pa

    documents = pa.table({"doc_id": [r[0] for r in make_rows()], "text": [r[1] for r in make_rows()], "lang": ["en" if r[0] % 3 else None for r in make_rows()], "source": [f"src{r[0] % 5}" for r in make_rows()]})
    duck.register("documents", documents)
    for plan in (source_mix.MixPlan(), source_mix.MixPlan(percent=150, sources={"src1": 90}), source_mix.MixPlan(percent=1, max_epochs=1)):
        cols = ["doc_id", "domain", "lang", "source", "epoch", "tokens"]
        want = sorted(duck.sql(f"SELECT {', '.join(cols)} FROM ({source_mix.oracle_sql(plan)})").fetchall())
        assert sorted(map(tuple, source_mix.mix(docs, plan).select(*cols).collect())) == want
    taken = source_mix.mix_documents(docs)
    assert taken.columns == docs.columns and 0 < taken.count() < docs.count()
    assert source_mix.mix(empty(docs)).count() == 0


def test_shortages_go_to_siblings_first(spark):
    from nodetide.llm import source_mix

    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    plan = source_mix.MixPlan(domains={"web": 1, "books": 1}, langs={"en": 1}, sources={"a": 1, "b": 1, "c": 1}, percent=50, max_epochs=1)
    got = {r.source: r.budget for r in source_mix.leaf_budgets(leaves, plan).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def poured(caps, weights, budget):
    """Water filling by hand: shares by weight among those not full yet, again and again; whole tokens, rounded down."""
    from fractions import Fraction

    got, open_ = {}, set(caps)
    while open_:
        left = budget - sum(got.values())
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] * total <= left * weights[c]}
        if not full:
            return got | {c: min(caps[c], int(Fraction(left * weights[c], total))) for c in open_}
        got |= {c: caps[c] for c in full}
        open_ -= full
    return got


def test_budgets_against_water_filling(spark):
    from nodetide.llm import source_mix as m

    rng = random.Random(12)
    for trial in range(3):
        rows = [(d, lang, f"s{k}", rng.choice([0, 1, 7, 50, 900, 12345])) for d in ("web", "books", "forum") for lang in ("en", "de", "xx") for k in range(rng.randint(1, 4))]
        plan = m.MixPlan(sources={"s0": 3, "s1": 50}, percent=rng.choice([10, 70, 140]), max_epochs=rng.randint(1, 3))
        w = lambda name, table: table.get(name, plan.other)
        cap = {r[:3]: r[3] * plan.max_epochs for r in rows}
        want = {}
        domains = poured({d: sum(c for k, c in cap.items() if k[0] == d) for d in {k[0] for k in cap}}, {d: w(d, plan.domains) for d in plan.domains}, sum(r[3] for r in rows) * plan.percent // 100)
        for d, b in domains.items():
            langs = {k[1] for k in cap if k[0] == d}
            for lang, c in poured({x: sum(v for k, v in cap.items() if k[:2] == (d, x)) for x in langs}, {x: w(x, plan.langs) for x in langs}, b).items():
                leaves = {k[2]: v for k, v in cap.items() if k[:2] == (d, lang)}
                want |= {(d, lang, x): v for x, v in poured(leaves, {x: w(x, plan.sources) for x in leaves}, c).items()}
        got = {(r.domain, r.lang, r.source): r.budget for r in m.leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), plan).collect()}
        assert got == want, trial


def test_source_mix_awkward_rows(spark, monkeypatch):
    from nodetide.llm import source_mix as m

    rows = [(None, "a b c", None, None), (None, "a b", None, None), (1, None, "en", "src1"), (2, "", "en", "src1"), (2, "", "en", "src1"), (3, "w " * 50_000, "en", "src12")]
    d = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, source string, epoch string, tokens int")
    every = m.MixPlan(percent=100, max_epochs=1)
    for most in (50_000, 0):
        monkeypatch.setattr(m, "BROADCAST_ROWS", most)
        taken = m.mix_documents(d, every)
        assert taken.columns == d.columns and sorted(map(str, taken.collect())) == sorted(map(str, d.collect()))


def test_byte_bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    from nodetide.llm import byte_bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in make_rows():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, byte_bpe.digests(docs, path, P.PATTERN).collect())) == sorted(want)
    assert byte_bpe.digests(empty(docs), path, P.PATTERN).count() == 0
    rng = random.Random(3)
    c = byte_bpe.Codec(byte_bpe.rank_file(path), P.PATTERN)
    import numpy as np

    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x400, 0x500), 0x1F600 + rng.randrange(60), 10, 32])) for _ in range(rng.randrange(200)))
        ids = np.frombuffer(c.encode(t), "<i4").tolist()
        assert ids == enc.encode_ordinary(t) and c.decode(ids).decode() == t


def test_language_id(spark):
    import zlib

    from nodetide.llm import language_id

    rng = random.Random(4)
    parts = {"aa": ["tha", "ing", "er", "on"], "bb": ["ció", "que", "los", "ar"], "cc": ["sch", "ung", "ein", "zu"]}
    word = {k: lambda p=p: "".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for k, p in parts.items()}
    rows = [(i, " ".join(word[k]() for _ in range(rng.randint(5, 60))), k) for i in range(240) for k in (sorted(parts)[i % 3],)]
    rows += [(240, None, "aa"), (241, "", "bb"), (242, "12 345 !!", "cc"), (243, "tha ing", None), (None, "que los ciólos", "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    out = language_id.predict_documents(d).collect()
    lang = {i: k for i, _, k in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (240, 241, 242):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id != 243:
            assert r.lang_pred == lang[r.doc_id]
    assert language_id.predict_documents(d.limit(0)).count() == 0


def kneser_ney(words, order, alphabet):
    """p(character | history) by the textbook: recursive, over Counters. words: a list with repeats."""
    from collections import Counter

    levels = [Counter() for _ in range(order + 1)]
    for w in words:
        p = "\0" * (order - 1) + w + "\0"
        levels[order].update(p[i : i + order] for i in range(len(w) + 1))
    for n in range(order - 1, 0, -1):
        for g, c in levels[n + 1].items():
            levels[n][g[1:]] += c if g[:2] == "\0\0" else 1
    discounts = [0.0]
    for n in range(1, order + 1):
        one, two = (sum(c == k for c in levels[n].values()) for k in (1, 2))
        discounts.append(min(max(one / (one + 2 * two), 0.1), 0.9) if one + two else 0.5)

    def p(c, history):
        n = len(history) + 1
        lower = p(c, history[1:]) if history else 1 / (alphabet + 1)
        follow = {g: k for g, k in levels[n].items() if g[:-1] == history}
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(history + c, 0) - discounts[n], 0) / total + discounts[n] * len(follow) / total * lower

    return p


def test_grams_of_arrays_are_those_of_words():
    import numpy as np

    from nodetide.llm import language_id as L

    rng = random.Random(14)
    texts = [None, "", "a", "Ab c_d e1f", "İstanbul ΣΑΣ ﬃ ½x² 日本語 𝒳y ǅ", " \n\n", "x" * 9] + ["".join(chr(rng.choice([32, 95, 10, rng.randrange(48, 123), rng.randrange(0xA0, 0x600), rng.randrange(0x1F00, 0x3100), rng.randrange(0x1D400, 0x1D800)])) for _ in range(rng.randrange(80))) for _ in range(300)]
    for order in (2, 4):
        columns, sizes = L.grams_in(texts, order)
        got = ["".join(map(chr, g)) for g in np.column_stack(columns).tolist()]
        assert got == [g for t in texts for w in L.words_of(t) for g in L.grams_of(w, order)]
        assert sizes.tolist() == [sum(len(w) + 1 for w in L.words_of(t)) for t in texts]
    assert L.grams_in([], 4)[1].tolist() == []


def test_kneser_ney_against_brute_force(spark):
    import math

    from nodetide.llm import language_id as L

    rng = random.Random(6)
    say = lambda cs: "".join(rng.choice(cs) for _ in range(rng.randint(1, 6)))
    words = {"a": [say("theno") for _ in range(80)], "b": [say("zoüβ") for _ in range(30)] + ["zoo"] * 9, "c": ["x"]}
    rows = [(k, g) for k, ws in words.items() for w in ws for g in L.grams_of(w, 3)]
    grams = spark.createDataFrame(rows, "lang string, gram string").groupBy("lang", "gram").agg(__import__("pyspark.sql.functions", fromlist=["count"]).count("*").alias("c"))
    model = L.fit(grams, 3)
    alphabet = sorted({g[-1] for _, g in rows})
    asked = [h + c for h in ("\0\0", "\0t", "th", "he", "zo", "qq", "\0q", "qo") for c in [*alphabet, "?"]]
    found = {r.gram: r.p for r in L.look_up(spark.createDataFrame([(g,) for g in asked], "gram string").distinct(), model).collect()}
    assert model.languages == ["a", "b", "c"]
    for k, lang in enumerate(model.languages):
        p = kneser_ney(words[lang], 3, len(alphabet))
        for g in asked:
            assert abs(math.exp(found[g][k]) - p(g[-1], g[:-1])) < 1e-9, (lang, g)
        for h in {g[:-1] for g in asked}:
            assert abs(sum(math.exp(found[h + c][k]) for c in [*alphabet, "?"]) - 1) < 1e-9


def test_language_entropies_against_brute_force(spark, block_bytes=3000):
    import math

    import numpy as np

    from nodetide.llm import language_id as L

    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice(cs) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 30))), k) for i in range(60) for k, cs in (("xx", "abc"), ("yy", "bcd"))]
    rows += [(70, rows[0][1], "xx"), (70, rows[0][1], "xx"), (71, "Ab ba " * 20_000, "xx"), (None, "dd cc", "yy"), (72, None, "yy"), (73, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    calibrates = {r.text for r in d.selectExpr("text", f"pmod(xxhash64(text), {L.CALIBRATION}) = 0 AS c").filter("c").collect()}
    out = {(r.doc_id, r.lang_pred): r for r in L.predict_documents(d, block_bytes=block_bytes).collect()}
    import zlib

    train = {"xx": [], "yy": []}
    for i, t, k in rows:
        if k and t is not None and t not in calibrates and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            train[k] += L.words_of(t)
    alphabet = len({c for ws in train.values() for w in ws for c in w}) + 1
    models = {k: kneser_ney(ws, L.ORDER, alphabet) for k, ws in train.items()}
    memo = {}

    def entropy(t, k):
        ps = [(g[-1], g[:-1]) for w in L.words_of(t) for g in L.grams_of(w)]
        return -sum(memo.setdefault((k, x), math.log(models[k](*x))) for x in ps) / len(ps)

    checked = 0
    for i, t, _ in rows:
        if t and (i in (70, 71, None) or i < 12):
            e = {k: entropy(t, k) for k in models}
            best = min(sorted(e), key=e.get)
            assert any(r[0] == i and r[1] == best and abs(x.cross_entropy - e[best]) < 1e-6 for r, x in out.items()), (i, e)
            checked += 1
    assert checked > 20 and out[72, "und"].score == 0 and out[72, "und"].cross_entropy is None and out[73, "und"].rejected
    assert all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in out.values())


def test_language_without_training_rows_and_ties(spark):
    from nodetide.llm import language_id as L

    d = spark.createDataFrame([(1, "one two", None), (2, None, "en"), (3, "a", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.predict_documents(d).collect()} == {("und", 0.0)}
    same = spark.createDataFrame([(i, f"abc cab {j}", k) for i, j in enumerate(range(40)) for k in ("zz", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict_documents(same).collect()} == {"aa"}
    one = spark.createDataFrame([(i, "abc " * (i + 1), "aa") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict_documents(one).collect()} == {"aa"}


def test_quality_classifier(spark):
    import zlib

    from nodetide.llm import quality_classifier as q

    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["the", "then", "and", "river", "stone", "walks", "under"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 90)))
    rows = [(i, say() if i % 2 else "BUY!! " * rng.randint(20, 80), i % 2) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(400, None), (401, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 1), (None, 0), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in q.score_documents(d, labels).collect()}
    assert len(out) == 403
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and sum(out[i].held_out for i in range(400)) == len(held)
    assert sum(out[i].predicted == i % 2 for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert q.score_documents(d.limit(0), labels).count() == 0
    assert {r.score for r in q.score_documents(d, labels.limit(0)).collect()} == {0.5}


def test_quality_classifier_awkward_rows(spark):
    from nodetide.llm import quality_classifier as q

    rows = [(i, ("fine words in a row " * (i % 9 + 3)) if i % 2 else "!!! ### $$$ " * (i % 9 + 3)) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "fine words"), (301, "long and fine words " * 200_000), (302, None)]
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, x string, y int").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(300)] + [(7, 0, 0), (7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, x int")
    out = q.score_documents(d, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert {r.held_out for r in out if r.doc_id is None} == {False}


def test_normal_equations_against_numpy(spark):
    import numpy as np

    from nodetide.llm import quality_classifier as q

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, len(q.STATISTICS))), rng.integers(0, 2, 500).astype(float)
    model = q.Model(x.mean(0), x.std(0), rng.normal(size=(len(q.STATISTICS), 20)), rng.uniform(0, 6, 20))
    d = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(500)], "x array<double>, y double")
    z = model.features(x)
    a, v = q.normal_equations(d, model)
    assert np.allclose(a, z.T @ z) and np.allclose(v, z.T @ y)
    a, v = q.normal_equations(d.limit(0), model)
    assert not a.any() and not v.any()


def test_byte_bpe_awkward_rows(spark):
    import public_tokenizers as P

    from nodetide.llm import byte_bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(None, "no id"), (1, None), (2, "a" * 300_000), (2, "a" * 300_000), (3, "x" * 65 + " " + "x" * 65), (4, "\u00a0\u2003 \n\n\n  tail ")]
    d = spark.createDataFrame([(*r, [9], "clash") for r in rows], "doc_id long, text string, ids array<int>, n_tokens string")
    out = byte_bpe.digests(d, path, P.PATTERN).collect()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in out), key=str) == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    coded = byte_bpe.encode(d, path, P.PATTERN, to="tokens")
    assert coded.columns == [*d.columns, "tokens"]
    back = byte_bpe.decode(byte_bpe.encode(d, path, P.PATTERN), path, P.PATTERN)
    assert {bytes(r.decoded).decode() for r in back.collect()} == {t or "" for _, t in rows}
    c = byte_bpe.Codec(byte_bpe.rank_file(path), P.PATTERN)
    c.encode("y" * 500)
    assert all(len(s) <= byte_bpe.LONG for s in c.known)


def test_isotonic():
    import numpy as np

    from nodetide.llm.quality_classifier import isotonic

    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0, 5, 2, 9.0]), np.array([9.0, 10, 10, 10]))
    assert (np.diff(y) >= 0).all() and x[0] == 0.0 and abs(np.interp(1.5, x, y) - 7.5 / 21) < 1e-9
