"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression that rejects a document. A random sample of about SAMPLE_ROWS rows of the whole table tells how
often each rule rejects and how long it takes (over REPEATS passes, less what the passes take without a rule); rules then run in falling
order of rejections per cost, and a document that one rule rejects is not looked at by the next. The order changes the work, never the verdict.

Repeated windows are found by 64-bit hashes within one text, so two different windows of a text would have to collide to count as a repeat.

Defined cases: a null or blank text has no words and fails the base rules; a null doc_id is an ordinary row;
repeated rows get the same figures; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import SPACE, WORD, words

#: Rows, on average, that the cost and selectivity estimate looks at; how often it looks; in how many tasks.
SAMPLE_ROWS = 400
REPEATS = 10
SAMPLE_TASKS = 4
SAMPLE_SEED = 17
MIN_WORDS = 20
WINDOW = 8
#: More than so many per cent of the words in repeated windows fails.
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`reject(text, words)` is true for documents to drop."""

    name: str
    reject: object


def _adjacent_repeats(w: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))


def _content_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


#: Production rules. All compare integers, so that every engine decides alike.
RULES = (
    Rule("symbols", lambda t, w: F.regexp_count(t, F.lit(SYMBOLS)) * 10 > F.size(w) * 3),
    Rule("upper_case", lambda t, w: F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > F.length(t) - F.regexp_count(t, F.lit(SPACE))),
    Rule("word_length", lambda t, w: (F.length(t) - F.regexp_count(t, F.lit(SPACE)) > F.size(w) * 20)),
    Rule("repeated_lines", lambda t, w: (F.size(_content_lines(t)) - F.size(F.array_distinct(_content_lines(t)))) * 2 > F.size(_content_lines(t))),
    Rule("stutter", lambda t, w: _adjacent_repeats(w) * 10 > F.size(w) * 3),
)


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics of each text, leaving the columns of `docs` as they are, plus `_words`.

    Repeated windows are found inside the row: 64-bit hashes of the windows are sorted with their positions, and
    equal neighbours are repeats. Texts whose hashes are all distinct skip the sort.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", words(F.col(text)))
    n = F.size("_words")
    d = d.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.sort_array(
        F.filter(
            F.transform("_s", lambda x, k: F.when((x["h"] == F.get(F.col("_s"), k + 1)["h"]) | (x["h"] == F.get(F.col("_s"), k - 1)["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    covered = F.aggregate(again, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")), lambda a: a["sum"])
    lines = _content_lines(t)
    return d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "_lines": lines,
        "n_repeat_words": F.when(F.size("_s") > 0, covered).otherwise(0).cast("long"),
    }).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_h", "_s", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second on a random sample of about `rows` rows. Only counts come to the driver.

    Each row of the table is drawn by itself, so a task passes on what it drew and nothing is cut off. Without rows the order is as given."""
    total = docs.count()
    if not total:
        return list(rules)
    drawn = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(min(1.0, rows / total), SAMPLE_SEED)
    sample = drawn.repartition(SAMPLE_TASKS).withColumn("w", words(F.col("text"))).persist()
    n, *hits = sample.agg(F.count("*"), *[F.count_if(r.reject(F.col("text"), F.col("w"))) for r in rules]).first()
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(check: Column) -> float:
        """Of the quicker of two passes, after one that compiles."""
        job = again.agg(F.count_if(check))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    idle = seconds(F.length("text") + F.size("w") < 0)
    score = [((hit + 1) / (n + 2) / max(seconds(rule.reject(F.col("text"), F.col("w"))) - idle, 1e-3), -k) for k, (rule, hit) in enumerate(zip(rules, hits, strict=True))]
    sample.unpersist()
    return [rules[-k] for _, k in sorted(score, reverse=True)]


def cascade(rules: list[Rule], text: Column, w: Column) -> Column:
    """True where no rule rejects. CASE WHEN stops at the first rule that holds."""
    out = None
    for rule in rules:
        out = F.when(rule.reject(text, w), False) if out is None else out.when(rule.reject(text, w), False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """`docs` with the base statistics, base_failed and kept. The rules run in `order`, or else in the one that the sample tells."""
    order = order or plan_cascade(docs, rules, text)
    t = F.coalesce(F.col(text), F.lit(""))
    d = base_statistics(docs, text).withColumn("base_failed", base_failed())
    return d.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order, t, F.col("_words")))).drop("_words")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return apply_rules(docs.select("doc_id", "text")).select("doc_id", *_BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their own columns only."""
    own = [F.col("d")[c].alias(c) for c in docs.columns]
    held = docs.select(F.struct(*docs.columns).alias("d")).withColumn("text", F.col("d.text"))
    # The row number keeps the filter above the statistics: pushed below, it would compute them anew wherever it names them.
    judged = apply_rules(held).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_row") >= 0)).select(*own)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
key AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM win),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM key) WHERE c > 1),
rep AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8) AS p FROM dup) GROUP BY r),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
 CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
 length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
 CASE WHEN len(w) < 2 THEN 0 ELSE len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) END AS n_adj,
 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
y AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_upper * 2 > word_chars OR word_chars > n_words * 20 OR n_dup_lines * 2 > len(ls) OR n_adj * 10 > n_words * 3) AS kept FROM y
"""
