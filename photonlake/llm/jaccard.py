"""N-gram Jaccard join: all links of sets of word shingles at or above a threshold, and their components.

Equal sets are one class from the start. A class's shingles have one global order, rarest first, and two sets
that reach the threshold share a shingle within their prefixes of ``n - ceil(t * n) + 1`` shingles. Document
frequencies come from the low-hash quarter of all shingles; classes that it does not already rule out get
theirs from all of their shingles. Candidates meet in the inverted lists of the prefixes, first every class with one centre
of its lists, then the pairs whose classes are not connected yet and whose shared prefix can still reach the
overlap. Each query then looks for its candidates by DivideSkip.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import small, staged
from .text import Words, mix, raw_texts, slices

#: Share of the hash space whose frequencies are counted for all classes; more than 1 - threshold.
LOW = 0.25
#: Frequencies are told apart up to this one.
MOST_DF = 4096
#: One class in so many is looked at to find the shingles that may have very many, which are those that LIKELY of these classes have.
PART, LIKELY = 64, 256
#: Classes that a task keeps in mind while it reads.
SEEN = 1 << 20
#: Columns of a block of prefixes that are multiplied at once.
COLUMNS = 8192
#: Candidates of one query that are searched in one go.
CHUNK = 256
#: Classes of a list up to which all its pairs are candidates, and in a block of a longer one.
SHORT, BLOCK = 16, 1024
_TOP = np.uint64(1 << 63)
_WIDE = np.uint64(0xA24BAED4963EE407)


def _sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    raw = raw_texts(column)
    for a, z in slices(raw):
        w = Words(raw[a:z])
        doc, _, h = w.grams(k, short=True)
        order = np.argsort(doc, kind="stable") if len(doc) and np.any(np.diff(doc) < 0) else None
        if order is not None:
            doc, h = doc[order], h[order]
        ends = np.searchsorted(doc, np.arange(w.n + 1))
        for i in range(w.n):
            x = np.sort(h[ends[i] : ends[i + 1]])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def _class_of(x: np.ndarray) -> int:
    return int(np.sum(mix(x ^ _WIDE)).astype(np.uint64).view(np.int64)) if len(x) else 0


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def row_key():
    """Hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n (size of the set), cls (the set's class), n_low, toks (the low hashes, or the prefix if that is longer; a class has none where its task has just given them)."""
    low = np.uint64(LOW * 2**64)

    def of(batches):
        given: set[int] = set()
        for batch in batches:
            n, cls, lows, toks = [], [], [], []
            for x in _sets(batch.column(2), k):
                few = int(np.searchsorted(x, low))
                n.append(len(x))
                cls.append(_class_of(x))
                lows.append(few)
                toks.append((x[: max(few, prefix_length(len(x), num, den) if len(x) else 0) if cls[-1] not in given else 0] ^ _TOP).view(np.int64))
                given.add(cls[-1])
            if len(given) > SEEN:
                given.clear()
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in toks]))).astype(np.int32)
            values = np.concatenate(toks) if toks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(lows, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "row", "n", "cls", "n_low", "toks"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, row long, n long, cls long, n_low long, toks array<long>")


def frequencies(postings: DataFrame) -> DataFrame:
    """tok, cls, df of the shingles that two classes or more have, from tok, cls. Lists that may be very long are counted in two steps, apart from the rest."""
    hot = staged(postings.where(F.pmod(F.xxhash64("cls"), F.lit(PART)) == 0).groupBy("tok").count().where(F.col("count") >= LIKELY).select("tok"))
    n = hot.count()
    if not n:
        return _listed(postings)
    many = staged(postings.join(small(hot, n), "tok", "left_semi").distinct())
    counts = many.groupBy("tok").agg(F.least(F.count("*"), F.lit(MOST_DF)).alias("df")).where("df > 1")
    return _listed(postings.join(small(hot, n), "tok", "left_anti")).unionByName(many.join(small(counts, n), "tok").select("tok", "cls", "df"))


def _listed(postings: DataFrame) -> DataFrame:
    """frequencies() in one shuffle; lists pass through in a stream."""

    def of(batches):
        tok, cls, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        last = None

        def emit(tok, cls, df):
            return pa.RecordBatch.from_arrays([pa.array(tok), pa.array(cls), pa.array(np.minimum(df, MOST_DF))], ["tok", "cls", "df"])

        for batch in batches:
            t, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(t):
                continue
            new = np.concatenate(([last is None or (t[0], c[0]) != last], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
            last = (t[-1], c[-1])
            t, c = t[new], c[new]
            if over is not None:  # the rest of a list that is known to be long
                k = int(np.searchsorted(t, over, "right"))
                if k:
                    yield emit(t[:k], c[:k], np.full(k, MOST_DF))
                t, c = t[k:], c[k:]
                if len(t):
                    over = None
            tok, cls = np.concatenate((tok, t)), np.concatenate((cls, c))
            if not len(tok):
                continue
            starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            size = np.diff(np.concatenate((starts, [len(tok)])))
            df = np.repeat(size, size)
            end = starts[-1] if size[-1] < MOST_DF else len(tok)
            keep = df[:end] >= 2
            if keep.any():
                yield emit(tok[:end][keep], cls[:end][keep], df[:end][keep])
            if end == len(tok):
                over = tok[-1]
            tok, cls = tok[end:], cls[end:]
        if len(tok) >= 2:
            yield emit(tok, cls, np.full(len(tok), len(tok)))

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "tok").sortWithinPartitions("tok", "cls").mapInArrow(of, "tok long, cls long, df long")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], need: list[int], mu: float = 0.05) -> list[int]:
    """Indices of the sets that share at least need[i] values with the query.

    The query's values have inverted lists over the sets. The longest ones are put aside, fewer than the least
    need; the others are merged through a heap, and a set that occurs in them often enough is looked up in
    the long ones by binary search.
    """
    if not sets or not len(query):
        return []
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    at = np.searchsorted(query, values)
    at[at == len(query)] = 0
    hit = query[at] == values
    at, which = at[hit], which[hit]
    order = np.lexsort((which, at))
    at, which = at[order], which[order]
    ends = np.searchsorted(at, np.arange(len(query) + 1))
    lists = sorted((which[a:z].tolist() for a, z in zip(ends, ends[1:]) if z > a), key=len)
    least = min(need)
    if len(lists) < least:
        return []
    long_n = min(len(lists), max(0, min(least - 1, int(least / (mu * np.log2(len(lists[-1]) + 1) + 1)))))
    short, long = lists[: len(lists) - long_n], lists[len(lists) - long_n :]
    found: dict[int, int] = {}
    for i in heapq.merge(*short):
        found[i] = found.get(i, 0) + 1
    out = []
    for i, count in found.items():
        left = len(long)
        for one in reversed(long):
            if count >= need[i] or count + left < need[i]:
                break
            left -= 1
            j = bisect_left(one, i)
            count += j < len(one) and one[j] == i
        if count >= need[i]:
            out.append(i)
    return sorted(out)


def verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b whose overlap reaches the threshold; full: cls, toks (all, ascending)."""
    work = pairs.select("a", "b", F.expr(f"cast(pmod(xxhash64(b), greatest(1, cast(ceil(count(*) over (partition by a) / {CHUNK}) as int))) as int)").alias("chunk"))
    sides = work.select("a", "chunk", "b").unionByName(work.select("a", "chunk", F.col("a").alias("b")).distinct())
    sides = sides.join(full.select(F.col("cls").alias("b"), "toks"), "b")

    def of(key, pdf):
        a = key[0]
        mine = pdf["b"].to_numpy() == a
        query = np.asarray(pdf["toks"][mine].iloc[0])
        ids, sets = pdf["b"][~mine].tolist(), [np.asarray(x) for x in pdf["toks"][~mine]]
        need = [-(-num * (len(query) + len(s)) // (den + num)) for s in sets]
        got = [ids[i] for i in divide_skip(query, sets, need)]
        return pd.DataFrame({"a": np.full(len(got), a, np.int64), "b": np.array(got, np.int64)})

    return sides.groupBy("a", "chunk").applyInPandas(of, "a long, b long")


def searched(lists: DataFrame, prefix: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b that join the components which meet in long lists: in each list only those that join two of them.

    Lists are cut into blocks of BLOCK classes, and two blocks meet in a task. A pair is looked at in the list of its first common shingle,
    and only if the shingles that their prefixes share, with all behind them, can reach the overlap.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    work = lists.select("tok", "cls", "component", mine.alias("g"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    work = work.select("tok", "cls", "component", F.least("g", "o").alias("g1"), F.greatest("g", "o").alias("g2"), "g")
    parts = prefix.select("cls", "n", "p", F.col("l.tok").alias("l"), F.col("end.df").alias("end_df"), F.col("end.tok").alias("end_tok"))

    def candidates(tok, g1, g2, pdf):
        """Row of pdf, the rows that it may link to, and the overlaps that these need."""
        prefixes = [np.asarray(x) for x in pdf["l"]]
        size = [len(x) for x in prefixes]
        row, values = np.repeat(np.arange(len(pdf)), size), np.concatenate(prefixes)
        early = np.concatenate([np.arange(len(x)) < int(np.flatnonzero(x == tok)[0]) for x in prefixes])
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        common = count[column] > 1
        row, early, (_, column) = row[common], early[common], np.unique(column[common], return_inverse=True)
        end = np.empty(len(pdf), np.int64)
        end[np.lexsort((pdf["end_tok"], pdf["end_df"]))] = np.arange(len(pdf))
        block, comp, p, n = (pdf[c].to_numpy() for c in ("g", "component", "p", "n"))
        left, right = np.flatnonzero(block == g1), np.flatnonzero(block == g2)
        shared, before = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column, early = row[order], column[order], early[order]
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, z = np.searchsorted(column, (c, c + COLUMNS))
            every = np.zeros((len(pdf), min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
            every[row[a:z], column[a:z] - c] = 1
            shared += every[left] @ every[right].T
            every[row[a:z][~early[a:z]], column[a:z][~early[a:z]] - c] = 0
            before += every[left] @ every[right].T
        first = before == 0
        for i, x in enumerate(left):
            need = -(-num * (n[x] + n[right]) // (den + num))
            rest = np.where(end[x] <= end[right], n[x] - p[x], n[right] - p[right])
            ok = first[i] & (shared[i] + rest >= need) & (comp[right] != comp[x]) & (num * np.maximum(n[x], n[right]) <= den * np.minimum(n[x], n[right]))
            if g1 == g2:
                ok &= right > x
            if ok.any():
                yield x, right[ok], need[ok]

    def active(key, pdf):
        rows = np.zeros(len(pdf), bool)
        for x, y, _ in candidates(*key, pdf):
            rows[x] = rows[y] = True
        return pdf.loc[rows, ["tok", "g1", "g2", "cls", "component", "g"]]

    def links(key, pdf):
        comp, cls = pdf["component"].to_numpy(), pdf["cls"].to_numpy()
        sets = [np.asarray(x) for x in pdf["toks"]]
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        a, b = [], []
        for x, y, need in candidates(*key, pdf):
            ok = np.fromiter((root(comp[x]) != root(c) for c in comp[y]), bool, len(y))
            y, need = y[ok], need[ok]
            for k in divide_skip(sets[x], [sets[i] for i in y], need.tolist()):
                r, s = root(comp[x]), root(comp[y[k]])
                if r != s:
                    up[max(r, s)] = min(r, s)
                    a.append(cls[x])
                    b.append(cls[y[k]])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    schema = "tok long, g1 int, g2 int, cls long, component long, g int"
    some = staged(work.join(parts, "cls").groupBy("tok", "g1", "g2").applyInPandas(active, schema))
    return some.join(parts.join(full, "cls"), "cls").groupBy("tok", "g1", "g2").applyInPandas(links, "a long, b long")


def row_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, row (its row_key), n_shingles, component, lowest of every row of docs; see jaccard_components.

    component tells components apart whatever their ids, null without words; lowest is the smallest doc_id in it.
    """
    ratio = f"{num} * greatest(n, m) <= {den} * least(n, m)"
    sig = staged(signatures(docs, k, num, den))
    classes = sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("n_low").alias("n_low"))
    shared = frequencies(sig.where("n > 0").select(F.explode("toks").alias("tok"), "cls"))
    edge = int(LOW * 2**64) - 2**63
    low = shared.where(F.col("tok") < F.lit(edge)).groupBy("cls").agg(F.count("*").alias("dup"))
    p = f"n - cast(ceil({num} * n / {den}) as long) + 1"
    open_ = staged(classes.join(low, "cls", "left").where(f"n_low - coalesce(dup, 0) < {p}").select("cls", "doc_id", "n"))
    rows = open_.count()

    def whole(batches):
        for batch in batches:
            toks = [(x ^ _TOP).view(np.int64) for x in _sets(batch.column(1), k)]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in toks]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_class_of((t.view(np.uint64)) ^ _TOP) for t in toks], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(toks) if toks else np.empty(0, np.int64)))], ["cls", "toks"])

    ids = small(open_.select(F.col("doc_id").alias("_id")), rows)
    full = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(whole, "cls long, toks array<long>")
    full = staged(full.join(small(open_.select("cls"), rows), "cls", "left_semi").dropDuplicates(["cls"]))

    # every shingle of the open classes with its frequency; those of the low part count over all classes, which are open or have no share in lists
    df = frequencies(full.select(F.explode("toks").alias("tok"), "cls"))
    own = df.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("l"))
    prefix = full.select("cls", F.size("toks").cast("long").alias("n")).join(own, "cls").withColumn("p", F.expr(p)).withColumn("slots", F.expr("p - (n - size(l))")).where("slots > 0")
    prefix = prefix.select("cls", "n", "p", F.expr("slice(l, 1, cast(slots as int))").alias("l")).withColumn("end", F.expr("element_at(l, -1)"))
    prefix = staged(prefix)
    lists = prefix.select("cls", "n", "p", "end", F.size("l").alias("slots"), F.posexplode("l.tok").alias("i", "tok"))

    centre = lists.groupBy("tok").agg(F.min(F.struct("cls", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    star = lists.join(centre.select("tok", F.col("c.cls").alias("o"), F.col("c.n").alias("m")), "tok").where(f"cls <> o and {ratio}")
    star = star.groupBy("cls", "o").count().groupBy("cls").agg(F.max(F.struct("count", "o")).alias("best")).select(F.col("best.o").alias("a"), F.col("cls").alias("b"))
    first = staged(verified(star, full, num, den))
    comp = connected_components(first)

    named = lists.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = named.groupBy("tok").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y").select("tok", "size")
    left = staged(named.join(mixed, "tok"))
    few = left.where(F.col("size") <= SHORT)
    other = few.select("tok", *[F.col(c).alias(o) for c, o in (("cls", "o"), ("n", "m"), ("p", "q"), ("end", "oend"), ("slots", "oslots"), ("i", "j"), ("component", "oc"))])
    # shared shingles of the two prefixes, as far as their places in both lists allow, with all that follows the prefix that ends first
    reach = f"least(i, j) + 1 + least(slots - i, oslots - j) - 1 + if(end <= oend, n - p, m - q) >= ceil({num} * (n + m) / {den + num})"
    more = few.join(other, "tok").where(f"cls < o and component <> oc and {ratio} and {reach}").select(F.col("cls").alias("a"), F.col("o").alias("b")).distinct()
    more = verified(more, full, num, den).unionByName(searched(left.where(F.col("size") > SHORT), prefix, full, num, den))
    second = staged(more.distinct())
    if not second.isEmpty():
        comp = connected_components(first.unionByName(second))

    best = classes.select("cls", F.col("doc_id").alias("low")).join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = best.groupBy("component").agg(F.min("low").alias("lowest"))
    ids = best.join(lowest, "component").select("cls", "component", "lowest")
    return sig.join(ids, "cls", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), "component", "lowest")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    A set holds the distinct runs of k words; a text of fewer words has one run, and without words (or null) none and no
    link. Two documents link when ``den * intersection >= num * union``; component_id is the smallest doc_id within reach.
    Repeated rows and equal texts are linked. Rows without doc_id take part; a component of such rows alone has
    a null id. An empty table gives an empty one; more columns of docs are ignored.
    """
    return row_components(docs, k, num, den).select("doc_id", "n_shingles", F.expr("if(n_shingles = 0, doc_id, lowest)").alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows by brute force over all shingles that two texts share.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT doc_id, sh FROM s WHERE sh IN (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1)),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shared x JOIN shared y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT reach.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id"""
