"""Language identification by interpolated Kneser-Ney character models that grow with the corpus.

Training counts every word of every training row, per language: character n-grams of order ORDER inside a word that is padded with boundaries. All lower
orders follow from the distinct n-grams, as Kneser-Ney asks: an n-gram counts once for each character that comes before it; one that begins with a boundary,
which nothing else comes before, keeps its own count. One discount per language and order comes from the counts of counts, over all n-grams. Counts, discounts
and interpolated probabilities are Spark joins and aggregates; nothing is left out, and of the model only the languages, their alphabet's size and their discounts
reach the driver.

Documents are packed into blocks (see `blockwise`). A block asks for the n-grams that it holds, once each; the answers are their log-probabilities under every
language, found order by order: the probability of an n-gram that a language has, or else the context's back-off weight and the next lower order. The block keeps
its answers as a sorted array of 64-bit n-gram hashes beside a matrix, and gives each document the language with the lowest cross-entropy per
character. So a block's model is bounded by the block, whatever the model's size.

The score is a calibrated probability that the language is right: a logistic fit of the margin between the best two languages. It is fitted on one of CALIBRATION training
texts (by hash of the text), which the counts leave out, all of them, counted in bins of margin. `rejected` marks scores below REJECT.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the first language by name; repeated rows repeat; an empty table
gives an empty result; without training rows everything is `und` with score 0; with one language the score is that of an endless margin; a null doc_id is an ordinary training row;
language, source and id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.llm import blockwise
from nodetide.llm.common import cut

ORDER = 4
#: One of so many training texts calibrates the score and isn't counted.
CALIBRATION = 16
REJECT = 0.5
BLOCK_BYTES = 8 << 20
#: Characters that a worker turns into arrays at a time, one text at least.
SLICE = 1 << 19
#: Margins are counted in bins of this width, in nats a character, up to so many bins.
BIN, BINS = 0.002, 2000
#: Slope and offset of the score before any row calibrates it; they weigh as much as a few rows.
PRIOR = (40.0, 0.0)
EDGE = "\x00"
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return _LETTERS.findall((text or "").lower())


def grams_of(word: str, n: int = ORDER) -> list[str]:
    """The n-grams of a padded word, one for each letter and one for its end."""
    p = EDGE * (n - 1) + word + EDGE
    return [p[i : i + n] for i in range(len(word) + 1)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point, whether words_of takes it for a letter."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given as columns of code points from the first character to the last."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def grams_in(texts: list[str | None], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of all words of some texts, as columns of code points, and how many each text has. The same as grams_of of words_of, in one pass over arrays."""
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
    points = np.frombuffer("".join(t + "\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    columns, back = [points], points
    for n in range(1, order):
        before = np.concatenate((np.zeros(min(n, len(points)), np.uint32), points[: max(0, len(points) - n)]))
        back = np.where(back == 0, 0, before) if n > 1 else before  # nothing before a boundary counts
        columns.insert(0, back)
    use = (points != 0) | (columns[-2] != 0)  # letters, and the ends of words
    total = np.concatenate(([0], np.cumsum(use)))[ends] if len(ends) else np.zeros(0, np.int64)
    return [c[use] for c in columns], np.diff(np.concatenate(([0], total)))


def _slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) with about `most` characters together, one text at least."""
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        text = t.as_py()
        n = len(text or "")
        if held and size + n > most:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(text)
        size += n
    if held:
        yield begin, held


# ---- counting and the model ----------------------------------------------------------------------------


def count_grams(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, h, counts: its count per language in the block's training rows), a row for each n-gram of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                yield _counted(block, blockwise.unpack(data.as_py()), order)

    return blocks.select("block", "rows").mapInArrow(run, "block long, gram string, h long, counts map<string,long>")


def _counted(block: int, rows: pa.RecordBatch, order: int) -> pa.RecordBatch:
    """The n-grams of one block with their counts per language."""
    langs = rows.column("learn").to_pylist()
    names = sorted({x for x in langs if x is not None})
    code = {x: i for i, x in enumerate(names)} | {None: len(names)}
    of = np.array([code[x] for x in langs], np.int64)
    hashes, points, counts = [np.zeros(0, np.int64)], [np.zeros((0, order), np.uint32)], [np.zeros((0, len(names)), np.int64)]
    for begin, texts in _slices(rows.column("text")):
        columns, sizes = grams_in(texts, order)
        place, distinct = pd.factorize(_hash(columns))
        first = np.zeros(len(distinct), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        lang = np.repeat(of[begin : begin + len(texts)], sizes)
        hashes.append(distinct)
        points.append(np.column_stack([c[first] for c in columns]))
        counts.append(np.bincount(place * (len(names) + 1) + lang, minlength=len(distinct) * (len(names) + 1)).reshape(len(distinct), len(names) + 1)[:, :-1])
    every, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros((len(every), len(names)), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    text = np.concatenate(points)[first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    at, lang = np.nonzero(total)
    offsets = np.concatenate(([0], np.cumsum((total > 0).sum(1))))
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([names[k] for k in lang.tolist()], pa.string()), pa.array(total[at, lang], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(every), block)), pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), pa.array(every), maps], ["block", "gram", "h", "counts"])


def levels(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(lang, gram, c) of the orders 1 to `order`, from (lang, gram, c) of the highest."""
    out = [grams]
    for n in range(order - 1, 0, -1):
        above = out[0]
        tail = F.substring("gram", 2, n)
        begins = (F.substring("gram", 1, 1) == EDGE) & (F.substring("gram", 2, 1) == EDGE)
        out.insert(0, cut(above.groupBy("lang", tail.alias("gram")).agg(F.sum(F.when(begins, F.col("c")).otherwise(1)).alias("c")), f"order{n}"))
    return out


@dataclass
class Model:
    """languages; log-probability of a character that no language knows (one for each); per order (gram, p: map of language number to log-probability) and, from
    order 2 on, (context, w: map of language number to log back-off weight)."""

    order: int
    languages: list[str]
    floor: list[float]
    grams: list[DataFrame]
    contexts: list[DataFrame | None]


def fit(grams: DataFrame, order: int = ORDER) -> Model:
    """The model of (lang, gram, c) of the highest order."""
    spark = grams.sparkSession
    level = levels(grams, order)
    names = [r.lang for r in level[0].select("lang").distinct().orderBy("lang").collect()]  # a row for each language
    alphabet = level[0].select("gram").distinct().count()  # of characters
    uniform = -float(np.log(alphabet + 1))
    if not names:
        return Model(order, [], [], [], [])
    codes = F.broadcast(spark.createDataFrame(list(enumerate(names)), "l int, lang string"))
    floor, tables, contexts = [uniform] * len(names), [], []
    below: DataFrame | None = None
    for n, rows in enumerate(level, 1):
        rows = rows.join(codes, "lang").select("l", "gram", F.col("c").cast("double").alias("c"), F.substring("gram", 1, n - 1).alias("context"))
        kinds = {r.l: (r.one, r.two) for r in rows.groupBy("l").agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).collect()}
        # One discount a language: n1 / (n1 + 2 n2) over all its n-grams of this order; half a count where there are no such n-grams.
        discount = {k: min(max(one / (one + 2 * two), 0.1), 0.9) if one + two else 0.5 for k, (one, two) in kinds.items()}
        d = F.element_at(F.create_map(*[F.lit(x) for k, v in discount.items() for x in (k, v)]), F.col("l"))
        same = W.partitionBy("l", "context")  # no more rows than there are characters
        rows = rows.withColumn("total", F.sum("c").over(same)).withColumn("w", d * F.count("*").over(same) / F.col("total"))
        lower = F.lit(float(np.exp(uniform)))
        if n > 1:
            rows = rows.withColumn("tail", F.substring("gram", 2, n - 1)).join(below.select("l", F.col("gram").alias("tail"), F.col("p").alias("q")), ["l", "tail"])
            lower = F.col("q")
        below = cut(rows.select("l", "gram", "context", "w", ((F.col("c") - d) / F.col("total") + F.col("w") * lower).alias("p")), f"p{n}")
        if n == 1:
            weight = {r.l: r.w for r in below.select("l", "w").distinct().collect()}  # a row for each language
            floor = [uniform + float(np.log(weight[k])) for k in range(len(names))]
        tables.append(below.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("l", F.log("p")))).alias("p")))
        contexts.append(None if n == 1 else below.groupBy("context", "l").agg(F.first("w").alias("w")).groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("l", F.log("w")))).alias("w")))
    return Model(order, names, floor, tables, contexts)


def look_up(asked: DataFrame, model: Model) -> DataFrame:
    """(gram, p: array of one log-probability per language, of its last character after the others) of distinct asked(gram) of the highest order."""
    size = len(model.languages)
    every = F.sequence(F.lit(0), F.lit(size - 1))
    found: DataFrame | None = None
    for n in range(1, model.order + 1):
        # A tail of all n-grams asked for: what a lower order is asked.
        wanted = asked.select(F.substring("gram", model.order - n + 1, n).alias("gram")).distinct()
        held = wanted.join(model.grams[n - 1], "gram", "left")
        if n == 1:
            floor = F.array(*map(F.lit, model.floor))
            found = held.select("gram", F.transform(every, lambda l: F.coalesce(F.element_at("p", l), F.get(floor, l))).alias("p"))  # noqa: E741
        else:
            own = held.withColumns({"context": F.substring("gram", 1, n - 1), "tail": F.substring("gram", 2, n - 1)})
            own = own.join(model.contexts[n - 1], "context", "left").join(found.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail")
            value = lambda l: F.coalesce(F.element_at("p", l), F.coalesce(F.element_at("w", l), F.lit(0.0)) + F.get(F.col("q"), l))  # noqa: E731, E741
            found = own.select("gram", F.transform(every, value).alias("p"))
    return found


# ---- scoring -------------------------------------------------------------------------------------------


def cross_entropies(texts: pa.Array, keys: np.ndarray, table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: [texts, languages] cross-entropy per character, and its characters (a word has one more than its letters, its end). keys are the sorted hashes of
    all n-grams of the texts, table their rows."""
    entropy, size = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    # Where a key stands, by its last bits; keys that lost their slot to another are searched for.
    bits = np.int64((1 << max(1, (4 * len(keys)).bit_length())) - 1)
    slot = np.zeros(bits + 1, np.int64)
    slot[keys & bits] = np.arange(len(keys))
    for begin, part in _slices(texts):
        columns, sizes = grams_in(part, order)
        h = _hash(columns)
        at = slot[h & bits]
        if len(h):
            missed = np.flatnonzero(keys[at] != h)
            at[missed] = np.searchsorted(keys, h[missed])
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            entropy[begin + full] = -np.add.reduceat(table[at], starts, axis=0) / sizes[full, None]
            size[begin + full] = sizes[full]
    return entropy, size


def margins(entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How much lower the best language is than the second, in nats a character, shrunk for short texts."""
    if entropy.shape[1] < 2:
        return np.full(len(entropy), BIN * BINS)
    two = np.partition(entropy, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(size / (size + 20.0))


def compare(blocks: DataFrame, answers: DataFrame, model: Model, columns: dict[str, str]) -> DataFrame:
    """`columns` (names and types) of every row of the blocks, with best (language number, -1 for none), margin and cross_entropy; answers(block, h, p)."""
    order, languages = model.order, len(model.languages)
    own = answers.groupBy("block").agg(F.collect_list(F.struct("h", "p")).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = blockwise.unpack(batch.column("rows")[i].as_py())
                got = batch.column("got")[i].values
                keys, table = np.zeros(0, np.int64), np.zeros((0, languages))
                if got is not None and len(got):
                    keys = got.field("h").to_numpy(zero_copy_only=False)
                    table = got.field("p").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), languages)
                    at = np.argsort(keys)
                    keys, table = keys[at], table[at]
                entropy, size = cross_entropies(rows.column("text"), keys, table, order)
                best = np.where(size > 0, entropy.argmin(1), -1)
                cross = pa.array(np.where(size > 0, entropy.min(1), np.nan), mask=size == 0)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(best, pa.int32()), pa.array(np.where(size > 0, margins(entropy, size), 0.0)), cross], [*columns, "best", "margin", "cross_entropy"])

    met = blocks.join(own.hint("shuffle_hash"), "block", "left").select("rows", "got")
    return met.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in columns.items()) + ", best int, margin double, cross_entropy double")


def calibrate(counted: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and offset of P(right | margin) from (bin, rows, right rows), with a weak pull to PRIOR."""
    x = np.array([(b + 0.5) * BIN for b, _, _ in counted])
    n, y = np.array([r for _, r, _ in counted], float), np.array([r for _, _, r in counted], float)
    design = np.column_stack((x * 10, np.ones(len(x)))) if len(x) else np.zeros((0, 2))
    prior = np.array([PRIOR[0] / 10, PRIOR[1]])
    beta, penalty = prior.copy(), np.diag([0.05, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (n * p * (1 - p))[:, None]) + penalty
        beta += np.clip(np.linalg.solve(h, design.T @ (y - n * p) - penalty @ (beta - prior)), -5, 5)
    return (float(beta[0] * 10), float(beta[1])) if beta[0] > 0 else PRIOR


def predict_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of each row; trains on the rows that are not held out and have a language and a text."""
    out = held_out(F.col("doc_id"))
    truth = F.when(~out & F.col("text").isNotNull(), F.col("lang"))
    sets_score = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), out.alias("held_out"), F.when(~sets_score, truth).alias("learn"), F.when(sets_score, truth).alias("truth"))
    blocks, _ = blockwise.pack(d, block_bytes=block_bytes)
    counted = cut(count_grams(blocks, order), "grams")
    learnt = cut(counted.select("gram", F.explode("counts").alias("lang", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("c")), "learnt")
    model = fit(learnt, order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not model.languages:
        return docs.select("doc_id", out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    found = look_up(counted.select("gram").distinct(), model)
    answers = counted.select("block", "gram", "h").join(found, "gram").select("block", "h", "p")
    judged = cut(compare(blocks, answers, model, {"doc_id": kind, "held_out": "boolean", "truth": "string"}), "judged")
    names = F.array(*map(F.lit, model.languages))
    named = F.get(names, F.col("best"))
    bins = judged.filter("truth IS NOT NULL AND best >= 0").groupBy(F.least(F.floor(F.col("margin") / BIN), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.count_if(named == F.col("truth")).alias("right"))
    slope, offset = calibrate([(r.bin, r.n, r.right) for r in bins.collect()])  # BINS rows at most
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("margin") + offset)))
    score = F.when(F.col("best") < 0, 0.0).otherwise(chance)
    return judged.select("doc_id", "held_out", F.when(F.col("best") < 0, UNKNOWN).otherwise(named).alias("lang_pred"), score.alias("score"), "cross_entropy", (score < REJECT).alias("rejected"))
