"""Quality rules as a short-circuit cascade (DataFrame functions only).

Counts over whole texts are columns, and rules are predicates over counts. On a sample every count is timed and every
rule's share of rejected rows is taken; the cascade asks the rules in descending order of rejection per cost, and a rule
is not evaluated for a row that an earlier one rejected. The order changes cost and the reported reason, never the
verdict. A count that is no result stands inside the branches that read it, not in a column below them.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import SPACE, table, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Rows (about, a hash draw) on which costs and selectivities are estimated; the verdict doesn't depend on them.
SAMPLE_ROWS = 1_000


@dataclass(frozen=True)
class Rule:
    """A row is rejected where `test` holds for the counts it reads; `rejects` is the same in SQL."""
    name: str
    counts: tuple[str, ...]
    rejects: str
    test: Callable[..., Column]


#: Limits of the rules (parameters).
BASE = (
    Rule("few_words", ("n_words",), "n_words < 50", lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words", lambda n, r: 100 * r > 50 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), "word_chars > 14 * n_words OR word_chars < 2 * n_words", lambda n, c: (c > 14 * n) | (c < 2 * n)),
    Rule("symbols", ("n_words", "n_symbols"), "5 * n_symbols > n_words", lambda n, s: 5 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "2 * n_dup_lines > n_lines", lambda n, d: 2 * d > n),
    Rule("shouting", ("n_words", "n_shouted"), "10 * n_shouted > 3 * n_words", lambda n, s: 10 * s > 3 * n),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted")


def prepared(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, _t, _w, _l, _h): the whole row, the text, its words, its lines, and hashes of every three words in a row."""
    w = F.col("_w")
    d = docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("_t")).withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    return d.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))


def repeated_words(h: Column) -> Column:
    """Words inside the windows that occur twice. Hashes are sorted with their places, so repeats are neighbours; a
    repeat's places, sorted again, cover three words each, less what the one before covers already."""
    pair = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        # each element beside its neighbours; null beyond the ends
        trio = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("y"), F.slice(s, 2, F.size(s)).alias("z"))
        twin = F.filter(trio, lambda t: t["x"].isNotNull() & (F.coalesce(t["x"]["h"] == t["y"]["h"], F.lit(False)) | F.coalesce(t["x"]["h"] == t["z"]["h"], F.lit(False))))
        return F.array_sort(F.transform(twin, lambda t: t["x"]["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("bigint").alias("n"), i.alias("last")))["n"]

    # one-element arrays bind a value once inside an expression
    bound = F.transform(F.array(F.array_sort(pair)), lambda s: covered(places(s)))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.get(bound, F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def count_columns() -> dict[str, Column]:
    """The counts by name, over the columns of `prepared`."""
    found = {
        "n_words": F.size("_w"),
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(repeated_words(F.col("_h")), F.lit(0)),
        "n_shouted": F.regexp_count("_t", F.lit(r"\p{Lu}{2,}")),
    }
    return {n: c.cast("bigint") for n, c in found.items()}


def rest_of(docs: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of `docs` that are not called like one of the results."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]


def counted(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = COUNTS) -> DataFrame:
    """docs with the named counts. Null has no words; a line counts if it has a word. Other columns stay, but a column
    called like a count is replaced by it. Repeated rows are counted each; an empty table stays empty."""
    made = count_columns()
    return prepared(docs, text_col).select(*rest_of(docs, names), *[made[n].alias(n) for n in names])


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per second on a hash sample of about `rows` rows; ties by name. A count's seconds are those of
    a job over the sample less those of a job that counts nothing."""
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("rules")), F.lit(1 << 20))
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(draw < math.ceil(share * (1 << 20))).cache()

    def seconds_of(value: Column) -> float:
        began = time.perf_counter()
        prepared(sample, "text").agg(F.sum(value)).first()
        return time.perf_counter() - began
    try:
        seen = counted(sample, "text").agg(F.count("*").alias("_n"), *[F.count_if(F.expr(r.rejects)).alias(r.name) for r in rules]).first()
        made = count_columns()
        nothing = min(seconds_of(F.char_length("_t")) for _ in range(2))
        seconds = {n: max(min(seconds_of(made[n]) for _ in range(2)) - nothing, 1e-3) for n in COUNTS}
    finally:
        sample.unpersist()
    n = max(seen["_n"], 1)
    return sorted(rules, key=lambda r: (-(seen[r.name] / n) / sum(seconds[c] for c in r.counts), r.name))


def cascade(rules: list[Rule], count: Callable[[str], Column] = F.col) -> Column:
    """Name of the first rule that rejects a row, null if none does; CASE stops at the first. `count` gives a count."""
    out = None
    for r in rules:
        test = r.test(*[count(n) for n in r.counts])
        out = F.when(test, F.lit(r.name)) if out is None else out.when(test, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", returned: tuple[str, ...] = ()) -> DataFrame:
    """docs with the `returned` counts and `rejected_by` (null: kept).

    Only the returned counts are columns that every row has. Any other count stands inside the branch of the rule that
    reads it, so it is evaluated only for the rows that reach this rule. Nulls, repeated rows, empty tables and clashing
    names as in `counted`.
    """
    made = count_columns()
    known = prepared(docs, text_col).select("*", *[made[n].alias(f"_{n}") for n in returned])
    by = cascade(ordered(docs, rules, id_col, text_col), lambda n: F.col(f"_{n}") if n in returned else made[n])
    return known.select(*rest_of(docs, (*returned, "rejected_by")), *[F.col(f"_{n}").alias(n) for n in returned], by.alias("rejected_by"))


def op8_quality_rules(spark, sf_dir):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), returned=names)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in BASE))
    return docs.select("doc_id", *names, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}{2,}'))::BIGINT AS n_shouted
    FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (BASE) AS base_failed, NOT (ALL_RULES) AS kept FROM c
""".replace("BASE", " OR ".join(f"({r.rejects})" for r in BASE)).replace("ALL_RULES", " OR ".join(f"({r.rejects})" for r in RULES))
