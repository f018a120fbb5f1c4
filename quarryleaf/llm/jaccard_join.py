"""Exact self-join of documents on the Jaccard similarity of their word shingles, by a token-group matrix.

Equal sets collapse to one representative. Documents are partitioned into groups of similar ones. A table keeps each
group's members, another, made once, the union of their tokens. The matrix says which groups have which cells; a group's
documents are queries to the groups that share a cell with it, and first meet these groups' unions only: the overlap of a
query and a union bounds that with every member. Groups whose bound reaches the threshold are opened for that query.

The cells are exact part signatures rather than single tokens. The hash range is cut into P(size level) parts; the
signature of a part is the hash of the document's tokens in it. Two linked sets differ in at most d tokens, so of m
non-empty parts m - d at least are identical in both. A document is therefore looked up under its rarest parts only, all
but the m - d - 1 that most documents have: a passage that a third of the corpus shares makes no pairs, and a document
whose parts are mostly its own makes none at all. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import HEAVY_SHARE, Rows, batches, bitmap, bits_for, discard, heavy_left_join, in_bits, written
from quarryleaf.llm.components import components, roots

#: Documents of a group: a bound on what a task holds at once. Parts beyond those that links may destroy, as a factor.
GROUP_SIZE = 64
#: Groups of a cell that meet in one task, of either side.
CELL_BLOCK = 128
#: Shares that the rows of a heavy cell are dealt in.
CELL_SALTS = 64
_SLACK = 1.3
_FOREVER = 1 << 40


class Levels:
    """Size levels for a threshold num / den, a factor of (den / num) ** 3 each, and the parts of each level."""

    def __init__(self, num: int, den: int):
        if num * 10 < den * 7 or num > den:
            raise ValueError("similarities from 0.7 to 1: below, links may leave no part of a small set whole")
        self.num, self.den, low = num, den, [1]
        while low[-1] < _FOREVER:
            low.append(max(low[-1] + 1, -(-low[-1] * den**3 // num**3)))
        self.low = np.array(low, dtype=np.int64)
        self.high = self.low[1:] - 1
        self.parts = (self._differ(2 * self.high) * _SLACK).astype(np.int64) + 2

    def _differ(self, both: np.ndarray) -> np.ndarray:
        """Most tokens that are in one only of two linked sets with so many tokens in all."""
        return both * (self.den - self.num) // (self.den + self.num)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def differ(self, n: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The same for a set of n tokens and any partner of the level."""
        return self._differ(n + np.minimum(n * self.den // self.num, self.high[level]))

    def crosses(self, n: np.ndarray) -> np.ndarray:
        """Whether a set can be linked with a larger one of the next level."""
        return n * self.den >= self.low[self.of(n) + 1] * self.num


def token_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, off = textbuf.words(text)
    return textbuf.distinct_sets(*textbuf.shingles(h, off, k))


def _cells(tokens: np.ndarray, off: np.ndarray, level: np.ndarray, parts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the non-empty parts of each row (tokens ascending in each), and the rows' offsets."""
    n = np.diff(off)
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    part = ((tokens >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(textbuf.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
    tag = textbuf.mix(part[at] + (level[row[at]].astype(np.uint64) << np.uint64(40)) + (np.uint64(salt) << np.uint64(56)))
    return textbuf.mix(total + tag), np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(n)))))


def signatures(tokens: np.ndarray, off: np.ndarray, levels: Levels) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, signature, kind) arrays. kind: twice the parts beyond those that links may destroy, plus 1 on the next level.

    Where a row has no more non-empty parts than links may destroy, it emits a second partition by other hashes, and so
    on until one is good. A pair is covered by the first partition that is good for either of its rows.
    """
    n = np.diff(off)
    for cross in (0, 1):
        rows = np.flatnonzero((n > 0) & (levels.crosses(n) if cross else True))
        level = levels.of(n) + cross
        bound = levels.differ(n, level)
        rows = rows[bound[rows] > 0]  # else only equal sets are linked
        salt, t, o = 0, tokens, off
        while len(rows):
            if len(rows) < len(n) or salt:
                keep = np.zeros(len(n), dtype=bool)
                keep[rows] = True
                t_r = t[np.repeat(keep, np.diff(o))] if salt == 0 else np.concatenate([np.sort(textbuf.mix(tokens[off[r] : off[r + 1]] + np.uint64(salt))) for r in rows])
                o_r = np.concatenate(([0], np.cumsum(n[rows])))
            else:
                t_r, o_r = t, o
            sig, s_off = _cells(t_r, o_r, level[rows], levels.parts[level[rows]], salt)
            count = np.diff(s_off)
            slack = np.clip(count - bound[rows] - 1, -1, 10_000)
            where = np.repeat(np.arange(len(rows)), count)
            yield rows[where], sig, ((slack[where] + 1) * 2 + cross).astype(np.int16)
            rows = rows[slack < 0]
            salt += 1


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64), type=pa.int64())


def _linked(rows: Rows, shingle: int, num: int, den: int) -> DataFrame:
    """key, doc_id, n_shingles, class_id, class_size, comp (the smallest key reachable) and component_id of each row."""
    levels = Levels(num, den)

    def stats(it):
        for b in batches(it):
            tokens, off = token_sets(b.column("text"), shingle)
            a = textbuf.segment_sum(textbuf.mix(tokens), off)
            c = textbuf.segment_sum(textbuf.mix(tokens ^ np.uint64(0xA24BAED4963EE407)), off)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), _long(np.diff(off)), _long(a), _long(c)], ["key", "doc_id", "n_shingles", "ha", "hb"])

    known = written(rows.source.mapInArrow(stats, "key long, doc_id long, n_shingles long, ha long, hb long"))
    same_set = ["n_shingles", "ha", "hb"]
    classes = written(
        known.where("n_shingles > 0").groupBy(same_set)
        .agg(F.min("key").alias("class_key"), F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    )
    total = known.count()
    single = F.col("class_key").isNull()
    plain = written(heavy_left_join(known, classes, same_set, "class_size", total).select(
        "key", "doc_id", "n_shingles", F.coalesce("class_key", "key").alias("class_key"),
        F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")))
    discard(known)
    links = _components(Firsts(rows, plain), shingle, levels)
    sized = links.join(classes.select(F.col("class_key").alias("node"), "class_size"), "node", "left")
    comps = sized.select(F.col("node").alias("class_key"), "comp", F.coalesce("class_size", F.lit(1)).alias("_rows"))
    out = heavy_left_join(plain, comps, ["class_key"], "_rows", total).withColumn("comp", F.coalesce("comp", "class_key"))
    if not rows.any:
        return out.withColumn("component_id", F.col("comp"))
    # keys of repeated ids are hashes: a component is named by its smallest id instead
    out = written(out.drop("_rows"))
    low = out.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_rows"))
    return heavy_left_join(out, low, ["comp"], "_rows", total)


def jaccard_classes(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, class_size.

    Words are what lies between runs of the six ASCII white-space characters, A-Z lower-cased; a document's set is its
    distinct shingles of `shingle` words (fewer words: the whole sequence; none: the empty set, linked with nothing).
    Documents are linked where den * intersection >= num * union. component_id: the smallest doc_id reachable by links;
    class_id: the smallest doc_id with the same set (its own for the empty set); class_size: rows with that set.
    Null text counts as empty. Rows are linked one by one, also those with a repeated or null id; a component or class of
    null ids alone has a null one. Repeated rows count each. An empty table gives an empty one.
    Sets are compared by 64-bit shingle hashes and collapse by a 128-bit hash of the set.
    """
    return _linked(Rows(docs, id_col, text_col), shingle, num, den).select("doc_id", "n_shingles", "component_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all columns: that with the smallest id (where an id in it repeats or is null,
    any one). Rows of other components stay, whatever their ids; empty texts are components of their own, but of rows
    with the same id and text one stays."""
    rows = Rows(docs, id_col, text_col)
    return rows.without(_linked(rows, shingle, num, den).where("key <> comp").select("key"))


def _documents(group: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    marks = group.field("marks")
    off = np.asarray(marks.offsets)
    values = marks.values.to_numpy().view(np.uint16)
    return group.field("node").to_numpy(), group.field("comp").to_numpy(), group.field("n").to_numpy(), [values[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]


def qualifying(queries: pa.StructArray, union: np.ndarray, levels: Levels) -> list[int]:
    """The queries whose overlap with a group's union, by 16 bits of the tokens' hashes, lets them be linked with a
    member. Tokens that share their 16 bits within a query are added back, so that the bound is from above."""
    _, _, qn, qm = _documents(queries)
    seen = np.zeros(1 << 16, dtype=bool)
    seen[union.view(np.uint16)] = True
    return [k for k in range(len(qn)) if levels.den * (np.count_nonzero(seen[qm[k]]) + qn[k] - len(qm[k])) >= levels.num * qn[k]]


def open_group(queries: pa.StructArray, asked: np.ndarray, group: pa.StructArray, levels: Levels) -> tuple[list[int], list[int]]:
    """Pairs of these queries and members of another component that may be linked, by their 16-bit marks."""
    num, den = levels.num, levels.den
    (qi, qc, qn, qm), (xi, xc, xn, xm) = _documents(queries), _documents(group)
    q_out, x_out = [], []
    mine = np.zeros(1 << 16, dtype=bool)
    for k in asked:
        mine[qm[k]] = True
        fits = np.flatnonzero((xc != qc[k]) & (den * np.minimum(xn, qn[k]) >= num * np.maximum(xn, qn[k])))
        for j in fits:
            most = np.count_nonzero(mine[xm[j]]) + min(qn[k] - len(qm[k]), xn[j] - len(xm[j]))
            if (den + num) * most >= num * (qn[k] + xn[j]):
                q_out.append(min(qi[k], xi[j]))
                x_out.append(max(qi[k], xi[j]))
        mine[qm[k]] = False
    return q_out, x_out


def salted(cells: DataFrame, hot: Column) -> DataFrame:
    """Cells with a salt: 0, or for hot ones a copy for each of 1 to CELL_SALTS."""
    return cells.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(1), F.lit(CELL_SALTS))).otherwise(F.array(F.lit(0)))))


class Firsts:
    """The rows that are no copy of one with a smaller key, each key once, read anew from the source each time they are
    worked on: one Python step does the choosing and the work. Rows that the bitmaps leave open and rows that may share
    their key are set apart in a table, by an exact join."""

    def __init__(self, rows: Rows, known: DataFrame):
        self.spark = rows.spark
        ids = written(known.where("class_key <> key").select("key").distinct())
        size = bits_for(ids.count())
        mask = (1 << size) - 1
        at = F.xxhash64("key").bitwiseAND(F.lit(mask)).alias("pos")
        bits = self.spark.sparkContext.broadcast(bitmap(ids.select(at), size))

        def near(it):
            for b in it:
                yield b.filter(pa.array(in_bits(bits.value, b.column("h").to_numpy() & mask)))

        maybe = known.where("class_key = key").select("key", F.xxhash64("key").alias("h")).mapInArrow(near, "key long, h long")
        others = self.spark.sparkContext.broadcast(bitmap(maybe.select(at), size))
        self.source = rows.marked.select("key", "text", F.xxhash64("key").alias("h"), "shared")
        self.sure = lambda h, shared: ~shared & ~in_bits(bits.value, h & mask)
        schema = "key long, text string, h long, shared boolean"
        open_ = self._step(self.source, lambda h, shared: shared | (in_bits(bits.value, h & mask) & in_bits(others.value, h & mask)), lambda it: it, schema)
        self.open = written((open_.dropDuplicates(["key"]) if rows.any else open_).join(ids, "key", "left_anti"))

    @staticmethod
    def _step(df: DataFrame, keep, work, schema: str) -> DataFrame:
        def run(it):
            for_work = (b.filter(pa.array(keep(b.column("h").to_numpy(), b.column("shared").to_numpy(zero_copy_only=False)))) for b in it)
            yield from work(for_work)

        return df.mapInArrow(run, schema)

    def work(self, run, schema: str, among: DataFrame | None = None, col: str = "node") -> DataFrame:
        """run (an Arrow function of key and text) over all, or over those whose keys are among these and a few more."""
        sure = self.sure
        if among is None:
            first = self._step(self.source, sure, run, schema)
            return first.unionByName(self._step(self.open, lambda h, _: np.ones(len(h), dtype=bool), run, schema))
        ids = written(among.select(F.col(col).alias("key")).distinct())
        size = bits_for(ids.count())
        mask = (1 << size) - 1
        asked = self.spark.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("key").bitwiseAND(F.lit(mask)).alias("pos")), size))
        discard(ids)
        first = self._step(self.source, lambda h, shared: sure(h, shared) & in_bits(asked.value, h & mask), run, schema)
        return first.unionByName(self._step(self.open, lambda h, _: in_bits(asked.value, h & mask), run, schema))


def _components(firsts: Firsts, shingle: int, levels: Levels) -> DataFrame:
    """(node, comp) of the representatives that share a cell with others; one without any such row is alone."""

    def cells(keep, heavy: np.ndarray | None = None):
        def run(it):
            hot = np.zeros(0, np.uint64) if heavy is None else heavy
            for b in batches(it):
                tokens, off = token_sets(b.column("text"), shingle)
                ids = b.column("key").to_numpy(zero_copy_only=False)
                for row, sig, kind in signatures(tokens, off, levels):
                    some = keep(sig)
                    row, sig, kind = (row, sig, kind) if some is None else (row[some], sig[some], kind[some])
                    for a in range(0, len(row), 1 << 16):
                        z = slice(a, a + (1 << 16))
                        node = ids[row[z]]
                        salt = np.where(np.isin(sig[z], hot), 1 + textbuf.mix(node.astype(np.uint64)) % np.uint64(CELL_SALTS), 0).astype(np.int16)
                        yield pa.RecordBatch.from_arrays([_long(sig[z]), _long(node), pa.array(kind[z]), pa.array(salt)], ["sig", "node", "kind", "salt"])

        return run

    def rows_of(tokens: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tokens, type=kind))

    def sets(it):
        for b in batches(it):
            tokens, off = token_sets(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([b.column("key"), _long(np.diff(off)), rows_of(tokens.view(np.int64), off, pa.int64())], ["node", "n", "tokens"])

    def marks(it):
        for b in batches(it):
            tokens, off = token_sets(b.column("text"), shingle)
            short, s_off = textbuf.distinct_sets(tokens & np.uint64(0xFFFF), off)
            yield pa.RecordBatch.from_arrays([b.column("key"), _long(np.diff(off)), rows_of(short.astype(np.uint16).view(np.int16), s_off, pa.int16())], ["node", "n", "marks"])

    # cells that two documents have: counted by signature alone; only their rows are told from the documents
    shared = written(firsts.work(cells(lambda sig: None), "sig long, node long, kind short, salt short").groupBy("sig").agg(F.count("*").alias("rows"), F.min("node").alias("head")).where("rows > 1"))
    found = shared.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    size = bits_for(found.n)
    mask = np.uint64((1 << size) - 1)
    again = firsts.spark.sparkContext.broadcast(bitmap(shared.select(F.col("sig").bitwiseAND(F.lit(int(mask))).alias("pos")), size))
    # the rows of a heavy cell (1 / HEAVY_SHARE of these at most) are dealt by their documents, and meet a copy of its row each
    most = max(1.0, found["rows"] * HEAVY_SHARE)
    heavy = np.array([r.sig for r in shared.where(F.col("rows") > most).select("sig").collect()], dtype=np.int64).view(np.uint64)
    cell = firsts.work(cells(lambda sig: in_bits(again.value, (sig & mask).astype(np.int64)), heavy), "sig long, node long, kind short, salt short")
    members = written(cell.join(salted(shared, F.col("rows") > most), ["sig", "salt"]).select(
        "sig", "salt", "node", "rows", "head", (F.col("kind") % 2).alias("side"), F.expr("kind div 2").alias("least")))
    small = written(firsts.work(marks, "node long, n long, marks array<short>", members))
    num, den = F.lit(levels.num), F.lit(levels.den)

    def verified(pairs: DataFrame) -> DataFrame:
        """(q, x) pairs that are linked, by their whole sets."""
        pairs = written(pairs)
        ids = pairs.select(F.col("q").alias("node")).unionByName(pairs.select(F.col("x").alias("node")))
        both = written(firsts.work(sets, "node long, n long, tokens array<long>", ids))
        left = pairs.join(both.select(F.col("node").alias("x"), F.col("tokens").alias("xt"), F.col("n").alias("xn")), "x")
        common = F.size(F.array_intersect("tokens", "xt"))
        return written(left.join(both.withColumnRenamed("node", "q"), "q").where(common * den >= num * (F.col("n") + F.col("xn") - common)).select("q", "x"))

    # groups: each document joins the smaller one at the head of most of its cells; linked ones form components
    same = members.where("head < node").groupBy("node", "head").agg(F.count("*").alias("cells"), F.min("least").alias("least"))
    best = written(same.where("cells >= least").groupBy("node").agg(F.max(F.struct("cells", "head")).alias("best")).select("node", "best.head"))
    star = verified(best.select(F.col("head").alias("q"), F.col("node").alias("x")))
    tree = small.select("node").join(star.select(F.col("x").alias("node"), "q"), "node", "left").select("node", F.coalesce("q", "node").alias("parent"))
    group_of = roots(tree)

    # a document shares `least` cells at least with each linked one: one of them is among its rarest, less `least` - 1
    own = Window.partitionBy("node", "side", "least")
    rare = members.withColumn("_at", F.row_number().over(own.orderBy("rows", "sig"))).withColumn("_of", F.count("*").over(own))
    cells_ = rare.where("_at <= _of - least + 1").select("sig", "salt", "node").distinct()
    placed = written(cells_.join(group_of, "node"))
    crossing = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), F.max("salt").alias("salt")).where("low < top")
    cross = written(placed.join(salted(crossing.select("sig", "salt"), F.col("salt") > 0), ["sig", "salt"], "left_semi").drop("salt"))
    discard(placed)

    # the groups, of at most GROUP_SIZE documents of one head (in expectation): members, and the union of their tokens
    docs = cross.select("node", "comp").distinct().join(best, "node", "left").withColumn("head", F.coalesce("head", "node"))
    of_size = docs.groupBy("head").agg(F.ceil(F.count("*") / GROUP_SIZE).alias("cut"))
    grouped = written(docs.join(of_size, "head").select("node", "comp", F.xxhash64("head", F.pmod(F.xxhash64("node"), "cut")).alias("group")))
    held = written(grouped.join(small, "node").groupBy("group").agg(F.collect_list(F.struct("node", "comp", "n", "marks")).alias("docs")))
    unions = written(held.select(F.col("group").alias("gb"), F.array_distinct(F.flatten("docs.marks")).alias("union")))

    # the matrix: which groups have which cells; groups that share one meet, a cell of many groups in blocks of these
    matrix = written(cross.join(grouped.select("node", "group"), "node").groupBy("sig", "group").agg(F.min("comp").alias("low"), F.max("comp").alias("top")))
    wide = matrix.groupBy("sig").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("cut")).where("cut > 1")
    spread = written(matrix.join(wide, "sig", "left").withColumn("cut", F.coalesce("cut", F.lit(1))))
    one = spread.select("sig", "cut", F.col("group").alias("ga"), F.col("low").alias("la"), F.col("top").alias("ta"), F.pmod(F.xxhash64("group"), "cut").cast("int").alias("block"))
    other = spread.select("sig", F.col("group").alias("gb"), F.col("low").alias("lb"), F.col("top").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"))
    met = one.join(other, ["sig", "block"]).where((F.col("ga") <= F.col("gb")) & (F.least("la", "lb") < F.greatest("ta", "tb")))
    met = written(met.select("ga", "gb").distinct())

    def bounded(it):
        for batch in it:
            for ga, gb, queries, union in zip(batch.column("ga"), batch.column("gb"), batch.column("docs"), batch.column("union"), strict=True):
                asked = qualifying(queries.values, union.values.to_numpy(), levels)
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array([ga.as_py()], pa.int64()), pa.array([gb.as_py()], pa.int64()), pa.array([asked], pa.list_(pa.int32()))], ["ga", "gb", "asked"])

    queries = held.withColumnRenamed("group", "ga")
    opened = written(met.join(queries, "ga").join(unions, "gb").select("ga", "gb", "docs", "union").mapInArrow(bounded, "ga long, gb long, asked array<int>"))

    def members_of(it):
        for batch in it:
            for asked, one_, other_ in zip(batch.column("asked"), batch.column("a"), batch.column("b"), strict=True):
                q, x = open_group(one_.values, asked.values.to_numpy(), other_.values, levels)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64())], ["q", "x"])

    met_ = opened.join(held.select(F.col("group").alias("ga"), F.col("docs").alias("a")), "ga").join(held.select(F.col("group").alias("gb"), F.col("docs").alias("b")), "gb")
    linked = verified(met_.select("asked", "a", "b").mapInArrow(members_of, "q long, x long").distinct()).withColumnRenamed("x", "node")
    named = linked.join(group_of.select(F.col("node").alias("q"), F.col("comp").alias("a")), "q")
    edges = named.join(group_of.withColumnRenamed("comp", "b"), "node").select("a", "b").distinct()
    merged = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    return group_of.join(merged, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
