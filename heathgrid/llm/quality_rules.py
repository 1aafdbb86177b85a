"""Quality rules with thresholds that adapt to each language and source.

One pass over the texts gives whole-number measures of each document. Its rates go into one mergeable
quantile sketch per (lang, source, rate): counts of bins whose edges grow by GROWTH, so that a quantile
read from them is within GROWTH - 1 of a true one, whatever its size. Counts add up in any order:
partial sketches from any split of the rows merge to the same one, and those of a language's sources
merge to the language's, those of languages to the corpus's. Sketches hold the documents that the base
rules let through.

A ceiling is MARGIN times a tail quantile (LEVELS) of the group's sketch. A group is drawn towards its
language as PRIOR documents of the language would draw it, and a language so towards the corpus, which
decides for groups of few documents. No ceiling passes ALLOWANCE times that of the language, and no
language's that of the corpus, so that a source of mostly junk doesn't raise its own ceiling over it.
Nothing else sets a ceiling. A rate up to RESOLUTION, one word of the fewest that the base rules let
through, can't be told from none and counts as RESOLUTION.

Defined cases: a null text has no words and fails the base rules; null lang or source are a group of
their own; an empty table gives no rows; repeated rows are judged alike, and rows that share a doc_id
each by their own text; texts are measured whole, however long; further columns stay unused, or, in
rejects(), as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heathgrid.llm.common import WORD, slices, texts_of
from heathgrid.shared import cut, fresh, written

#: Rates that the sketches hold, with the share in thousandths of documents that a ceiling's quantile is to leave below it.
LEVELS = {"symbols": 900, "dup_lines": 995, "repeats": 995, "capitals": 995}
MARGIN, ALLOWANCE, PRIOR = 1.5, 2, 100
#: Rates are in ten-thousandths.
RESOLUTION, GROWTH = 200, 1.02
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def measure(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated(words), len(lines), sum(map(str.isupper, words)),
    )


def repeated(words: list[str]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    # a pair's rank is below n, so neither product can pass 2**63
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measures(docs: DataFrame, into: str = "measures") -> DataFrame:
    """docs without column text, unless it's wanted, and with a struct of the measures of text in every row."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([measure(x) for x in texts_of(batch)], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(names))], names)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + f", {into} struct<{', '.join(x.replace(' ', ': ') for x in MEASURES.split(', '))}>")


def rates(of: str = "") -> dict[str, Column]:
    per = lambda a, b: F.expr(f"least(10000 * {of}{a} div greatest({of}{b}, 1), 10000)")
    return {
        "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "capitals": per("n_capitals", "n_words"),
    }


def base_failed(of: str = "") -> Column:
    return F.expr(f"{of}n_words < 50 or 100 * {of}n_repeat_words > 50 * {of}n_words")


def sketch(measured: DataFrame, of: str = "measures.") -> DataFrame:
    """lang, source, rate, bin, n: add up n over any union of sketches to merge them."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("r")) for k, v in rates(of).items()))).alias("x")
    rows = measured.where(~base_failed(of)).select("lang", "source", bins)
    bin_of = F.expr(f"if(x.r <= {RESOLUTION}, 0, cast(ceil(ln(x.r / {RESOLUTION}D) / ln({GROWTH}D)) as int))")
    return rows.groupBy("lang", "source", "x.rate", bin_of.alias("bin")).agg(F.count("*").alias("n"))


def weighted(rows: DataFrame, keys: list[str], parent: DataFrame, on: list[str]) -> DataFrame:
    """keys, rate, bin, n: sketches drawn towards the parent's, which share the columns `on`; n is then in units of one document's share of the parent."""
    within = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*on, "rate"]]
    total = parent.groupBy(*on, "rate").agg(F.sum("n").alias("total"))
    own = rows.alias("a").join(total.alias("b"), within("a", "b")).select(*(f"a.{k}" for k in keys), "a.rate", "a.bin", (F.col("a.n") * F.col("b.total").cast("double")).alias("n"))
    groups = rows.select(*keys, "rate").distinct()
    above = groups.alias("a").join(parent.alias("b"), within("a", "b")).select(*(f"a.{k}" for k in keys), "a.rate", "b.bin", (F.col("b.n") * float(PRIOR)).alias("n"))
    return own.union(above).groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def tails(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, rate and the ceiling that each sketch's own tail quantile makes."""
    group = Window.partitionBy(*keys, "rate")
    level = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    seen = rows.withColumn("seen", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = F.min(F.when(F.col("seen") * 1000 >= level[F.col("rate")] * F.col("total"), F.col("bin")))
    return seen.groupBy(*keys, "rate").agg((MARGIN * RESOLUTION * F.pow(F.lit(GROWTH), at)).alias(name))


def ceilings(sketches: DataFrame) -> DataFrame:
    """lang, source and each rate's ceiling, from merged sketches; a group has at most 200 bins a rate."""
    by_lang = sketches.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n"))
    corpus = by_lang.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
    top = tails(corpus, [], "top")
    mid = tails(weighted(by_lang, ["lang"], corpus, []), ["lang"], "mid").join(top, "rate").select("lang", "rate", F.least("mid", ALLOWANCE * F.col("top")).alias("mid"))
    low = tails(weighted(sketches, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"], "low")
    same = F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rate") == F.col("b.rate"))
    most = low.alias("a").join(mid.alias("b"), same).select("a.lang", "a.source", "a.rate", F.least("a.low", ALLOWANCE * F.col("b.mid")).alias("most"))
    return most.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, F.col("most"))).alias(f"most_{k}") for k in LEVELS))


def judged(measured: DataFrame, own: str, into: str) -> DataFrame:
    """measured (with lang, source and the struct of measures, own) with a boolean: whether the rules keep the row."""
    limits = ceilings(sketch(measured.select("lang", "source", F.col(own).alias("measures"))))
    at = fresh(measured, into, "in_lang", "in_source", "most")
    limits = limits.select(F.col("lang").alias(at[1]), F.col("source").alias(at[2]), F.struct(*(f"most_{k}" for k in LEVELS)).alias(at[3]))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col(at[1])) & F.col("source").eqNullSafe(F.col(at[2])), "left")
    within = F.lit(True)
    for k, v in rates(f"{own}.").items():
        within &= v <= F.col(f"{at[3]}.most_{k}")
    return joined.withColumn(into, ~base_failed(f"{own}.") & F.coalesce(within, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs (doc_id, text, lang, source)."""
    measured = cut(measures(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(measured, "measures", "kept").select("doc_id", "measures.*", base_failed("measures.").alias("base_failed"), "kept")


def rejects(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    own, kept = fresh(docs, "measures", "kept")
    return judged(written(measures(docs, own)), own, kept).where(F.col(kept)).select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
t as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
b as (select doc_id, lang, source, w, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '\p{Ll}')))::bigint as n_capitals from t),
g as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as tri
      from (select doc_id, w, unnest(range(1, n_words - 1)) as i from b)),
c as (select doc_id, i, count(*) over (partition by doc_id, tri) as k from g),
r as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from c, (values (0), (1), (2)) v(j) where k > 1 group by doc_id),
m as (select b.* exclude (w), coalesce(n_repeat_words, 0) as n_repeat_words from b left join r using (doc_id)),
q as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
             least(10000 * n_symbols // greatest(word_chars, 1), 10000) as symbols, least(10000 * n_dup_lines // greatest(n_lines, 1), 10000) as dup_lines,
             least(10000 * n_repeat_words // greatest(n_words, 1), 10000) as repeats, least(10000 * n_capitals // greatest(n_words, 1), 10000) as capitals from m),
u as (select coalesce(lang, chr(1)) as lang, coalesce(source, chr(1)) as source, rate, case when r <= RESOLUTION then 0 else ceil(ln(r / RESOLUTION::double) / ln(GROWTH::double))::int end as bin
      from (select lang, source, rate, r from (from q where not base_failed) unpivot (r for rate in (symbols, dup_lines, repeats, capitals)))),
s0 as (select lang, source, rate, bin, count(*)::double as n from u group by all),
s1 as (select lang, rate, bin, sum(n) as n from s0 group by all),
s2 as (select rate, bin, sum(n) as n from s1 group by all),
w1 as (select lang, rate, bin, sum(n) as n from (select lang, rate, bin, n * (select sum(n) from s2 t where t.rate = s1.rate) as n from s1
       union all select g.lang, g.rate, s2.bin, PRIOR * s2.n from (select distinct lang, rate from s1) g join s2 using (rate)) group by all),
w0 as (select lang, source, rate, bin, sum(n) as n from (select lang, source, rate, bin, s0.n * t.n as n from s0 join (select lang, rate, sum(n) as n from s1 group by all) t using (lang, rate)
       union all select g.lang, g.source, g.rate, s1.bin, PRIOR * s1.n from (select distinct lang, source, rate from s0) g join s1 using (lang, rate)) group by all),
lv(rate, level) as (values LEVELS),
c2 as (select rate, MARGIN * RESOLUTION * pow(GROWTH::double, min(bin)) as c from (select *, sum(n) over (partition by rate order by bin) as seen, sum(n) over (partition by rate) as total from s2) join lv using (rate)
       where seen * 1000 >= level * total group by rate),
c1 as (select lang, rate, least(MARGIN * RESOLUTION * pow(GROWTH::double, min(bin)), ALLOWANCE * any_value(c2.c)) as c from (select *, sum(n) over (partition by lang, rate order by bin) as seen, sum(n) over (partition by lang, rate) as total from w1)
       join lv using (rate) join c2 using (rate) where seen * 1000 >= level * total group by lang, rate),
c0 as (select lang, source, rate, least(MARGIN * RESOLUTION * pow(GROWTH::double, min(bin)), ALLOWANCE * any_value(c1.c)) as c from (select *, sum(n) over (partition by lang, source, rate order by bin) as seen, sum(n) over (partition by lang, source, rate) as total from w0)
       join lv using (rate) join c1 using (lang, rate) where seen * 1000 >= level * total group by lang, source, rate),
x as (select lang, source, max(c) filter (rate = 'symbols') as a, max(c) filter (rate = 'dup_lines') as b, max(c) filter (rate = 'repeats') as c, max(c) filter (rate = 'capitals') as e from c0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
       not base_failed and coalesce(symbols <= a and dup_lines <= b and repeats <= x.c and capitals <= e, false) as kept
from q left join x on coalesce(q.lang, chr(1)) = x.lang and coalesce(q.source, chr(1)) = x.source
"""
for _k, _v in {"RESOLUTION": RESOLUTION, "GROWTH": GROWTH, "PRIOR": PRIOR, "MARGIN": MARGIN, "ALLOWANCE": ALLOWANCE, "LEVELS": ", ".join(f"('{k}', {v})" for k, v in LEVELS.items())}.items():
    ORACLE = ORACLE.replace(_k, str(_v))
