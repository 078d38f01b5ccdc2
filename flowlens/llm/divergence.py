"""How far the sources of a language are apart in their words (operator 12).

Tokens: one ``bytes.translate`` over the UTF-8 text lowers A-Z and blanks every other
ASCII byte that is no letter, ``bytes.split`` cuts at the blanks, and a ``Counter`` for
each document gives how often it has each term. A task adds its documents up by
(language, source, term) before anything is shuffled: occurrences, and documents.

Each language keeps the terms that at least ``LEAST`` of its documents have. A term that
a source has ``n`` times gets p = 1 + floor(10^9 * (n + 2) / (N + 2V)), where N is the
number of kept occurrences in the source and V the number of terms that its language
keeps; a pair of distributions differs in a term by f = floor((p - q)^2 / (p + q)).
All of it is integer arithmetic.

The sums over all kept terms stay sparse, though every source has a p for every term:
with p0 the p of a term that a source lacks, f(a, b) over the terms is V f(a0, b0), plus
what each source's own terms change against b0 (by distinct count, ``own_terms``), plus
what terms that both have change on top of that (``shared``, arrays of the sources
of one term in numpy: as many rows leave a task as there are pairs of sources).

Defined results: null text, lang and source are read as ''; every row counts as a
document, repeated rows and rows without doc_id too; a source without terms, and a
language that keeps none, is paired like any other (value 0 if V = 0); a source alone in
its language has no pair rows; ties rank by item in UTF-8 order; texts are read whole
whatever their length; an empty table gives an empty one. Columns other than text, lang
and source are not read. Rows out, and work on shared terms, grow with the square of the
number of sources of a language, as asked: the report is on all its pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Documents of its language that a kept term needs; ranks of the term part.
LEAST, TOP = 10, 10
#: Terms that a task counts before it hands them on.
HELD = 400_000
SCALE = 1_000_000_000
#: Lowers A-Z; keeps a-z and all bytes of other scripts; blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]
#: Cells (terms times sources) that are compared at once.
CELLS = 200_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the documents of a task, added up."""
    occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for group, n in occurrences.items():
            docs = documents[group]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([group[0]] * len(n), pa.string()),
                    "source": pa.array([group[1]] * len(n), pa.string()),
                    "term": pa.array(n.keys(), pa.binary()),
                    "n": pa.array(n.values(), pa.int64()),
                    "docs": pa.array([docs[t] for t in n], pa.int64()),
                }
            )
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            own = Counter(terms_of(text))
            occurrences[lang, source].update(own)
            documents[lang, source].update(own.keys())
        if sum(map(len, occurrences.values())) > HELD:
            yield from out()
    yield from out()


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, and over the language lang_n, of the terms that it keeps.
    One exchange by (lang, term) serves the sums by source and those by language."""
    small_batches(docs.sparkSession)
    read = docs.select(*(read_as(c) for c in GROUP), read_as("text").cast("binary").alias("text"))
    found = read.mapInArrow(count, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
    w = Window.partitionBy("lang", "term")
    counted = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counted.withColumns({"lang_n": F.sum("n").over(w), "docs": F.sum("docs").over(w)}).where(F.col("docs") >= LEAST).drop("docs")


def read_as(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def share(n: Column | int, N: Column, V: Column) -> Column:
    """p of a term with n occurrences; decimals hold 10^9 times any count."""
    above = (n if isinstance(n, Column) else F.lit(n)).cast("decimal(19,0)") + 2
    return F.call_function("div", above * F.lit(SCALE).cast("decimal(10,0)"), (N.cast("decimal(19,0)") + V.cast("decimal(19,0)") * 2)) + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def apart(p: Column, q: Column) -> Column:
    """f of two shares; at most 10^18 before it is divided."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources have change on top of ``own_terms``: (lang, a, b, value)
    of the terms of a task, added up. Rows: a term, and the sources that have it."""
    sums: dict[str, dict[tuple[str, str], int]] = defaultdict(Counter)
    for batch in batches:
        langs, has = batch.column("lang").dictionary_encode(), batch.column("has")
        flat = has.flatten()
        names = flat.field("source").dictionary_encode()
        source, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        lang_of, long = langs.indices.to_numpy(), np.diff(has.offsets.to_numpy())
        lang, row = np.repeat(lang_of, long), np.repeat(np.arange(len(long)), long)
        for k, name in enumerate(langs.dictionary.to_pylist()):
            mine = lang == k
            here, column = np.unique(source[mine], return_inverse=True)
            base = np.zeros(len(here), np.int64)
            base[column] = p0[mine]
            own, at = np.unique(row[mine], return_inverse=True)
            step = max(1, CELLS // max(1, len(here)))
            for lo in range(0, len(own), step):
                part = (at >= lo) & (at < lo + step)
                # a source that lacks a term has p0 there, which adds 0
                table = np.tile(base, (min(step, len(own) - lo), 1))
                table[at[part] - lo, column[part]] = p[mine][part]
                for j in range(len(here) - 1):
                    a, b, a0, b0 = table[:, j : j + 1], table[:, j + 1 :], base[j], base[j + 1 :]
                    change = (difference(a, b) - difference(a, b0) - difference(a0, b) + difference(a0, b0)).sum(axis=0)
                    for i in np.flatnonzero(change):
                        sums[name][names[here[j]], names[here[j + 1 + i]]] += int(change[i])
    for name, found in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [name] * len(found), "a": [a for a, _ in found], "b": [b for _, b in found], "value": pa.array(found.values(), pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = saved(kept_terms(docs), "kept")
    names = docs.select(*(read_as(c) for c in GROUP)).distinct()
    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("width"), F.sum("n").alias("lang_total"))
    groups = names.join(sizes, GROUP, "left").join(by_lang, "lang", "left").na.fill(0, ["total", "width", "lang_total"])
    # without kept terms there is nothing to divide by, and no p to give
    groups = saved(groups.withColumn("p0", F.when(F.col("width") > 0, share(0, F.col("total"), F.col("width")))), "groups")

    p = share(F.col("n"), F.col("total"), F.col("width"))
    both = kept.join(groups, GROUP).withColumn("p", p)
    terms = saved(both.select(*GROUP, "term", "n", "p", "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("width")).alias("q")), "terms")

    out = pairs(terms, groups).unionByName(top_terms(terms))
    return out.select("lang", "source", "part", "item", "value", "rank")


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The part ``pair``: every other source of the language, by value."""
    has = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("has")).where(F.size("has") > 1)
    extra = has.select("lang", "has").mapInArrow(shared, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # a source's terms with equal counts differ alike from a source that lacks them
    same = terms.groupBy(*GROUP, "p", "p0").agg(F.count("*").alias("m"))
    change = (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0"))) * F.col("m")
    own_terms = same.join(other, "lang").where("source != item").groupBy(*GROUP, "item").agg(F.sum(change).alias("value"))
    lacking = groups.join(other, "lang").where("source != item").select(*GROUP, "item", F.coalesce(apart(F.col("p0"), F.col("q0")) * F.col("width"), F.lit(0).cast("long")).alias("value"))
    ways = own_terms.union(own_terms.select("lang", "item", "source", "value")).union(extra).union(extra.select("lang", "b", "a", "value"))
    value = lacking.union(ways).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return value.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))


def top_terms(terms: DataFrame) -> DataFrame:
    """The part ``term``: terms that a source has more of than its language, to rank ``TOP``.
    The window's limit on ranks holds in each task before the rows of a source meet."""
    more = terms.where("p > q").select(*GROUP, F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
