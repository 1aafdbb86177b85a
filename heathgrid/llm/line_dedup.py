"""Lines that stand earlier in the corpus, alike or almost, in DataFrame operations only.

A line is a \\n-separated part of a text with a character other than white space; other parts always
stay. Lines are ordered by (doc_id, line number). A line goes if an equal line stands before it, or if
it has LEAST_CHARS characters or more and a line of as many stands before it, in its first place, within
edit distance MOST_EDITS.

The edit join: every distinct line is cut into MOST_EDITS + 1 segments, by its length alone. If two
lines are within the distance, some segment of the shorter one stands unchanged in the longer one, near
its own place. Each line is filed under keys of length, segment number and characters: for its own segments,
and for those of its substrings that can be a segment of a line up to MOST_EDITS shorter. Candidates must also agree closely in how often they have some common
characters. The last word has a banded bit-parallel edit distance: a bit for each diagonal within the
distance, moved on by one line character at a time for each number of edits.

Equal lines become one row before anything else, so a line that a third of all texts share costs one
row. Lines that share no key with another go no further than their keys. The keys that leave that step are (doc_id, line number), which no hot value can pile up. Texts are
shuffled by doc_id once, and rewritten from the numbers of the lines that stay.

Defined cases: a null text stays null and has no lines; an empty text stays empty; rows with the
same doc_id share the numbers of the lines that stay, so repeated rows stay alike; a null doc_id comes first in the order; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heathgrid.shared import written

MOST_EDITS = 2
LEAST_CHARS = 32
#: Characters whose numbers candidates compare.
COUNTED = ("etaoinsrhdlucm", "pfgwybvkqxjz ,")


#: SQL of a string of the six white-space characters.
WHITE = "' \\t\\n\\u000b\\f\\r'"


def exploded(docs: DataFrame) -> DataFrame:
    """doc, at, line of every line with a character other than white space."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.where(f"trim(both {WHITE} from line) != ''")


def firsts(docs: DataFrame) -> DataFrame:
    """doc, at of every distinct line's first place. Lines are told apart by two 64-bit hashes and their length."""
    keyed = exploded(docs).select("doc", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("again"), "line").alias("i"), F.octet_length("line").alias("n"))
    return keyed.groupBy("h", "i", "n").agg(F.min(F.struct("doc", "at")).alias("m")).select("m.doc", "m.at")


def with_small(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """docs joined by doc_id to small, which has a row of a few numbers for each its_doc: hashed, so that texts needn't be sorted."""
    return docs.join(small.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("its_doc")), how)


def chosen(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc, at, line, n (characters) of the places (doc, at)."""
    wanted = places.groupBy(F.col("doc").alias("its_doc")).agg(F.collect_set("at").alias("ats"))
    lined = with_small(docs.select("doc_id", "text"), wanted, "inner")
    # zipped before it's taken apart: an expression inside a lambda would be worked out for each line anew
    pairs = F.arrays_zip(F.split("text", "\n").alias("line"), F.expr(flags("split(text, '\\n')", "ats")).alias("flag"))
    rows = lined.select(F.col("doc_id").alias("doc"), F.posexplode(pairs).alias("at", "x")).where("x.flag = '1'")
    return rows.select("doc", "at", F.expr("explode(array(named_struct('line', x.line, 'n', char_length(x.line))))").alias("y")).select("doc", "at", "y.line", "y.n")


def shifts() -> list[tuple[int, int, int]]:
    """(less, number, shift): where, off its own place, segment `number` of a line shorter by `less` can stand unchanged in a line within the distance."""
    found = []
    for less in range(MOST_EDITS + 1):
        for i in range(1, MOST_EDITS + 2):
            left = i - 1  # edits that can lie before the segment, if no earlier segment is unchanged
            right = MOST_EDITS + 1 - i
            found += [(less, i, k) for k in range(max(-left, less - right), min(left, less + right) + 1)]
    return found


def keys() -> str:
    """SQL array of the keys of a line of n characters: of its own segments, and of every segment of a line within the distance and no longer that can stand in it. NULL where there is none.

    A lambda over a constant list: twelve such expressions in a row would make a method too long for
    the JVM to compile.
    """
    parts = MOST_EDITS + 1
    cases = ", ".join(f"named_struct('less', {a}, 'i', {i}, 'shift', {k})" for a, i, k in shifts())
    # the last segments are longer by one where needed
    extra = f"({parts} - (n - s.less) % {parts})"
    start = f"(1 + (s.i - 1) * ((n - s.less) div {parts}) + greatest(0, s.i - 1 - {extra}) + s.shift)"
    size = f"((n - s.less) div {parts} + if(s.i > {extra}, 1, 0))"
    # characters of a line of ASCII are found by their number, others by counting from the line's start
    piece = f"if(octet_length(line) = n, substring(cast(line as binary), int({start}), int({size})), cast(substring(line, int({start}), int({size})) as binary))"
    fits = f"n - s.less >= {LEAST_CHARS} and {start} >= 1 and {start} + {size} - 1 <= n"
    return f"transform(array({cases}), s -> if({fits}, xxhash64(n - s.less, s.i, {piece}), null))"


def counts(letters: str) -> Column:
    """How often a line has each of some characters, modulo 16, in four bits each."""
    packed = F.lit(0).cast("long")
    for c in letters:
        times = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c)))
        packed = packed * 16 + times.cast("long").bitwiseAND(F.lit(15).cast("long"))
    return packed


def near_counts(a: str, b: str) -> str:
    """SQL: an edit changes the numbers of two characters at most, by one each."""
    apart = (f"(shiftright({a}.{c}, {4 * k}) - shiftright({b}.{c}, {4 * k})) & 15" for c, x in (("c1", COUNTED[0]), ("c2", COUNTED[1])) for k in range(len(x)))
    return f"{' + '.join(f'least({x}, 16 - ({x}))' for x in apart)} <= {2 * MOST_EDITS}"


def within(a: str, b: str) -> str:
    """SQL: whether the edit distance of two lines is MOST_EDITS at most; for lines whose lengths differ by no more than that.

    After t characters of b, bit j of mask d says that the first t - MOST_EDITS + j characters of a become
    those t with d edits or fewer.
    """
    k, full = MOST_EDITS, (1 << (2 * MOST_EDITS + 1)) - 1
    letters = lambda x: f"slice(split({x}, ''), 1, char_length({x}))"
    # bit j: whether a's character there is b's character t + 1; get() gives null outside a
    same = " + ".join(f"if(get(p.a, t - {k - j}) = c, {1 << j}, 0)" for j in range(2 * k + 1))
    steps, before = [], None
    for d in range(k + 1):
        own = f"(s.r{d} & m)"
        if d:
            own = f"(({own} | s.r{d - 1} | shiftright(s.r{d - 1}, 1) | shiftleft({before}, 1)) & {full})"
        steps.append(f"'r{d}', {own}")
        before = own
    start = ", ".join(f"'r{d}', {sum(1 << (k + j) for j in range(d + 1)) & full}" for d in range(k + 1))
    last = f"shiftleft(1, size(p.a) - size(p.b) + {k})"
    walk = f"aggregate(transform(p.b, (c, t) -> {same}), named_struct({start}), (s, m) -> named_struct({', '.join(steps)}), s -> (s.r{k} & {last}) != 0)"
    return f"aggregate(array(named_struct('a', {letters(a)}, 'b', {letters(b)})), false, (z, p) -> {walk})"


def shared_keys(docs: DataFrame, places: DataFrame) -> DataFrame:
    """key and place (doc, at) of the lines of each key that several have."""
    lines = chosen(docs, places).where(f"n >= {LEAST_CHARS}")
    keyed = lines.select("doc", "at", F.explode(F.expr(keys())).alias("key")).where("key is not null")
    return keyed.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1").select("key", F.struct("doc", "at").alias("place"))


def near_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc, at of the lines, given by their first places, that a different line within the distance precedes.

    Of the keys of all lines, only those that two lines share matter, which are few: a count over each
    key keeps them, and only their lines' texts are fetched. The join asks whether there is an earlier
    line, and verifies inside, so a group of many alike lines makes no more rows than it has.
    """
    shared = written(shared_keys(docs, places))
    text = chosen(docs, shared.select("place.doc", "place.at").distinct())
    text = text.select(F.struct("doc", "at").alias("place"), "line", "n", counts(COUNTED[0]).alias("c1"), counts(COUNTED[1]).alias("c2"))
    rows = shared.join(text, "place")
    later, sooner = rows.alias("b"), rows.alias("a")
    close = f"a.key = b.key and a.place < b.place and abs(a.n - b.n) <= {MOST_EDITS} and {near_counts('a', 'b')} and {within('a.line', 'b.line')}"
    return later.join(sooner, F.expr(close), "left_semi").select("place.doc", "place.at").distinct()


def marked(docs: DataFrame) -> DataFrame:
    """docs with its_first (numbers of the lines that it is the first to hold) and its_near (those of them that a similar line precedes)."""
    places = written(firsts(docs))
    near = near_lines(docs, places).withColumn("near", F.lit(True))
    first = places.withColumn("near", F.lit(False))
    by_doc = first.union(near).groupBy(F.col("doc").alias("its_doc")).agg(
        F.collect_list(F.when(~F.col("near"), F.col("at"))).alias("its_first"), F.collect_list(F.when(F.col("near"), F.col("at"))).alias("its_near")
    )
    nothing = F.array().cast("array<int>")
    joined = with_small(docs, by_doc, "left").drop("its_doc")
    return joined.withColumn("its_first", F.coalesce("its_first", nothing)).withColumn("its_near", F.coalesce("its_near", nothing))


def flags(lines: str, ats: str) -> str:
    """SQL array of '0' and '1' for each line: whether its number is in ats. Found by one pass over sorted numbers, not by search."""
    order = f"concat(array(-1), array_sort({ats}), array(size({lines})))"
    runs = f"array_join(transform(sequence(1, size({ats}) + 1), j -> repeat('0', o[j] - o[j - 1] - 1)), '1')"
    return f"split(aggregate(array({order}), '', (z, o) -> {runs}), '')"


def rewritten(docs: DataFrame) -> DataFrame:
    """docs with its new text and its_lines, its_exact, its_close: numbers of lines, of lines equal to and of lines close to an earlier one."""
    found, lines = marked(docs), "split(text, '\\n')"
    zipped = F.arrays_zip(F.split("text", "\n").alias("l"), F.expr(flags(lines, "its_first")).alias("f"), F.expr(flags(lines, "its_near")).alias("k"))
    nonblank = f"trim(both {WHITE} from x.l) != ''"
    # n: lines; kept: those that stay, joined
    parts = F.expr(f"aggregate(array(its_zip), named_struct('n', 0L, 'kept', ''), (z, w) -> named_struct('n', cast(size(filter(w, x -> {nonblank})) as bigint), 'kept', array_join(transform(filter(w, x -> (x.f = '1' and x.k = '0') or not ({nonblank})), x -> x.l), '\\n')))")
    out = found.withColumn("its_zip", zipped).withColumn("its_parts", F.when(F.col("text").isNotNull(), parts))
    first, close, n = F.size("its_first").cast("long"), F.size("its_near").cast("long"), F.coalesce(F.col("its_parts.n"), F.lit(0).cast("long"))
    return out.select(
        *(F.col("its_parts.kept").alias("text") if c == "text" else F.col(c) for c in docs.columns),
        n.alias("its_lines"), F.greatest(n - first, F.lit(0).cast("long")).alias("its_exact"), close.alias("its_close"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_close, kept_chars, kept_md5 of every row."""
    out = rewritten(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("its_lines").alias("n_lines"), F.col("its_exact").alias("n_exact"), F.col("its_close").alias("n_close"), F.char_length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines that go taken out of its texts, and n_chars, if there is one, to match."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # in a struct, further columns can't meet the names used on the way
    packed = docs.select("doc_id", "text", *([F.struct(*rest).alias("rest")] if rest else []))
    out = rewritten(packed).select(*packed.columns)
    out = out.select(*(F.col("rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


ORACLE = rf"""
with l as (select doc_id, unnest(range(len(s))) as pos, unnest(s) as line from (select doc_id, string_split(text, chr(10)) as s from documents)),
r as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as is_line from l),
f as (select line, min(row(doc_id, pos)) as place, length(line) as n from r where is_line group by line),
g as (select * from f where n >= {LEAST_CHARS}),
p as (select distinct a.line from g a join g b on b.n between a.n - {MOST_EDITS} and a.n + {MOST_EDITS} and b.place < a.place and levenshtein(a.line, b.line) <= {MOST_EDITS}),
k as (select r.*, f.place = row(r.doc_id, r.pos) as first, p.line is not null as near from r left join f using (line) left join p using (line)),
t as (select doc_id, count(*) filter (is_line) as n_lines, count(*) filter (is_line and not first) as n_exact, count(*) filter (is_line and first and near) as n_close,
             coalesce(string_agg(line, chr(10) order by pos) filter (not is_line or (first and not near)), '') as kept from k group by doc_id)
select doc_id, n_lines, n_exact, n_close, length(kept)::bigint as kept_chars, md5(kept) as kept_md5 from t
"""
