"""Operator 2: exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document's shingles are put in one global order, rarest first.  Two documents
that reach the similarity share, for every l, at least l of the first
``n - ceil(t * n) + l`` shingles of each.  Every document gets its own l: a
longer prefix costs more postings, but a pair then has to share min(l, l')
prefix shingles before it is verified, so l is chosen by the estimated cost of
the candidates that its shingles' frequencies give.

1. Frequencies over all documents, in ``2**SKETCH_BITS`` hashed counters
   (fixed size; any global order gives exact results, this one gives few
   candidates).
2. Documents with one and the same shingle set become a class with its
   smallest id as representative; only representatives are joined.
3. Prefix shingles of one class drop out; the others' postings make lists.
4. Links only matter between different components, so a list is not expanded
   into its pairs.  A round takes the smallest id of each list as its pivot
   (later ones the smallest of each of 16, 256, ... slots of ids), pairs it
   with the list's documents of other components, and joins the components
   that the links found put together.  Pivots leave their lists, lists of one
   component are closed.  Pivots are partial minima and lists are joined with
   them, so a list of any length is split over tasks.
5. A pair is verified in full only if its prefixes share min(l, l') shingles
   and the bitmaps of its sets do not rule the similarity out; whole sets are
   read for what is left.

Shingles are 64-bit hashes of five words' hashes; sizes and overlaps are
counted on them, within one pair of documents.  Filters over ids and shingles
are sized by what they hold, up to ``MOST_FILTER_BITS``; they only thin out
what joins decide.

Defined cases: null, empty or blank text has no shingles and links with
nothing; a text of fewer than five words is one shingle; repeated rows are one
class; rows of one id with different texts are one node; rows without an id
keep their size and have no component; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm import _words as W
from mesolite.llm._fold import emit_chunks, fold_fixed
from mesolite.llm._spark import counted, discard, documents, written
from mesolite.llm.components import contracted, links_of

SKETCH_BITS = 20
MOST_MATCHES = 4
VERIFY_COST = 20.0
PIVOT_GROWTH = 16
MOST_FILTER_BITS = 1 << 28


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat sorted distinct shingles of each row and the rows' bounds in them."""
    hashes, first = W.fold_words(column)
    row, h = W.shingle_hashes(hashes, first, words)
    bounds = np.searchsorted(row, np.arange(len(first)))
    out, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        own = np.sort(h[bounds[i] : bounds[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def frequency_sketch(docs: DataFrame, text_col: str, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents hold a shingle, in hashed counters over all documents."""

    def run(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in W.pieces(batches, 0):
            flat, _ = shingle_sets(batch.column(0), words)
            at, n = np.unique((flat >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            total[at] += n.astype(np.int32)
        yield emit_chunks(total)

    got = fold_fixed(docs.select(text_col), run, "<i4", np.add)
    return got if len(got) else np.zeros(1 << bits, np.int32)


def prefix_of(shingles: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The shingles' adaptive prefix, rarest first, and the number of matches it asks for."""
    n = len(shingles)
    if n == 0:
        return shingles, 0
    count = sketch[(shingles >> np.uint64(64 - int(len(sketch)).bit_length() + 1)).astype(np.int64)]
    order = np.argsort(count, kind="stable")  # ties keep the order of the hashes
    least = -(-percent * n // 100)
    top = min(MOST_MATCHES, least)
    ends = n - least + np.arange(1, top + 1)
    others = np.cumsum(np.maximum(count[order[: ends[-1]]] - noise, 0.0))
    matches = np.arange(1, top + 1)
    cost = ends + VERIFY_COST * others[ends - 1] / matches
    best = int(np.argmin(cost))
    return shingles[order[: ends[best]]], int(matches[best])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def prefixes(docs: DataFrame, sketch: np.ndarray, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, l, head, bits): set size, digest of the set, matches asked for, prefix, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counters = shared.value
        load = counters.mean()
        noise = load + 4 * np.sqrt(load)
        for batch in W.pieces(batches, 1):
            flat, bounds = shingle_sets(batch.column(1), words)
            sizes = np.diff(bounds)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(flat + np.uint64(s)))]) for s in (1, 0x51ED270B)]
            d1, d2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            heads, bits, asks = [], [], np.zeros(len(sizes), np.int32)
            for i in range(len(sizes)):
                own = flat[bounds[i] : bounds[i + 1]]
                head, asks[i] = prefix_of(own, counters, noise, percent)
                heads.append(head)
                bits.append(bitmap(own) if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(asks, pa.int32()), _lists(heads), pa.array(bits, pa.binary())], names=["doc_id", "n", "d1", "d2", "l", "head", "bits"]
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, l int, head array<long>, bits binary")


def id_filter(ids: DataFrame, held: int) -> np.ndarray:
    """A Bloom filter over about ``held`` ids, sixteen bits for each up to ``MOST_FILTER_BITS``; it only thins out what is read."""
    bits = min(MOST_FILTER_BITS.bit_length() - 1, max(16, int(16 * held).bit_length()))

    def run(batches):
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            h = W.mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            for k in (0, 32):
                at = (h >> np.uint64(k)) & np.uint64((1 << bits) - 1)
                np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield emit_chunks(seen)

    got = fold_fixed(ids, run, "u1", np.bitwise_or)
    return got if len(got) else np.zeros(1 << (bits - 3), np.uint8)


def maybe_in(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    h, bits = W.mix(ids.astype(np.int64).view(np.uint64)), np.uint64(len(seen) * 8 - 1)
    ok = np.ones(len(ids), bool)
    for k in (0, 32):
        at = (h >> np.uint64(k)) & bits
        ok &= (seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, in a map of the least power of two of at least twice the shingles' bits."""
    size = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """The most elements that two sets of these bitmaps can share: each bit that only one has set is an element of its own."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):  # the upper half folds onto the lower one
        u = u[: len(u) // 2] | u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] | v[len(v) // 2 :]
    return min(n_x - int(np.bitwise_count(u & ~v).sum()), n_y - int(np.bitwise_count(v & ~u).sum()))


def candidate_sets(docs: DataFrame, ids: DataFrame, held: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, own): the sets of (at least) ``ids``, of which there are ``held``."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids, held))

    def run(batches):
        seen = shared.value
        for batch in batches:
            some = batch.filter(pa.array(maybe_in(batch.column(0).to_numpy(), seen)))
            for piece in W.pieces([some], 1):
                flat, bounds = shingle_sets(piece.column(1), words)
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists([flat[bounds[i] : bounds[i + 1]] for i in range(piece.num_rows)])], names=["id", "own"])

    found = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, "id long, own array<long>")
    return found.groupBy("id", F.xxhash64("own").alias("d")).agg(F.first("own").alias("own")).select("id", "own")  # repeated rows once


def thinned(table: DataFrame, seen: np.ndarray) -> DataFrame:
    """The rows of ``table`` whose first column, a long, the filter ``seen`` lets through."""
    shared = table.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(batch.column(0).to_numpy(), shared.value)))

    return table.mapInArrow(run, table.schema)


def sieve(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share the prefix shingles asked for and whose bitmaps do not rule out the similarity.

    ``info`` holds (id, n, l, head, bits).
    """
    side = lambda c: info.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("n", "l", "head", "bits")))

    def run(batches):
        for batch in batches:
            part = _parts(batch, ("heada", "headb"))
            ask = np.minimum(batch.column("la").to_numpy(), batch.column("lb").to_numpy())
            x, y = batch.column("bitsa"), batch.column("bitsb")
            nx, ny = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if _common(part("heada", i), part("headb", i)) >= ask[i]:
                    most = most_common(x[i].as_py(), int(nx[i]), y[i].as_py(), int(ny[i]))
                    keep[i] = 100 * most >= percent * (int(nx[i]) + int(ny[i]) - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _parts(batch: pa.RecordBatch, names: tuple[str, ...]):
    got = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in names}
    return lambda name, i: got[name][1][got[name][0][i] : got[name][0][i + 1]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets (id, own) reach the similarity."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("own").alias(f"own{c}"))

    def run(batches):
        for batch in batches:
            part = _parts(batch, ("owna", "ownb"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = part("owna", i), part("ownb", i)
                both = _common(x, y)
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def shared_postings(heads: DataFrame) -> tuple[DataFrame, int]:
    """(token, id, n, pos) of the prefix shingles that more than one row of ``heads`` (id, n, head) holds, and their number."""
    tokens = heads.select("id", F.explode("head").alias("token")).groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y"))
    tokens, n = counted(tokens.filter("x != y").select("token"), "tokens")
    shared = heads.sparkSession.sparkContext.broadcast(id_filter(tokens, n))

    def run(batches):
        seen = shared.value
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            token = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            keep = np.flatnonzero(maybe_in(token, seen))
            row = np.searchsorted(offsets, keep, side="right") - 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column(0).take(at), batch.column(1).take(at), pa.array((keep - offsets[row]).astype(np.int32))], names=["token", "id", "n", "pos"])

    some = heads.select("id", F.col("n").cast("int").alias("n"), "head").mapInArrow(run, "token long, id long, n int, pos int")
    return counted(some.join(tokens, "token"), "postings")


def could_link(percent: int) -> F.Column:
    """Whether two postings of one shingle can belong to similar sets if this shingle is the first common one."""
    least = F.ceil(percent * (F.col("n") + F.col("n_")) / (100 + percent))
    return (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")) & (F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) >= least)


def link_components(rows: DataFrame, held: int, check, percent: int) -> DataFrame | None:
    """(node, component) over all verified links among the lists (token, id, n, pos) of the ``held`` ``rows``; None without links.

    ``check`` gives the pairs of a written table (a, b) that reach the
    similarity.  A pair is let through where it could still reach it if this
    token is its first common one; the first common one of a similar pair
    always is.  Each round takes pivots out of all open lists, so it ends.
    """
    comps, slots = None, 1
    rows = rows.withColumn("component", F.col("id"))
    while held:
        slot = F.pmod(F.xxhash64("id"), F.lit(slots))
        pivots = rows.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("id", "n", "pos", "component")).alias("p"))
        pivots = written(pivots.select("token", *(F.col(f"p.{c}").alias(f"{c}_") for c in ("id", "n", "pos", "component"))), "pivots")
        apart = (F.col("component") != F.col("component_")) & (F.col("id") != F.col("id_"))
        pairs = rows.join(pivots, "token").filter(apart & could_link(percent))
        pairs, n = counted(links_of(pairs, "id", "id_"), "pairs")
        if n:
            comps = merged(comps, check(pairs))
        rows = rows.select("token", "id", "n", "pos").join(pivots.select("token", F.col("id_").alias("id")), ["token", "id"], "left_anti")
        if comps is None:
            rows = rows.withColumn("component", F.col("id"))
        else:
            rows = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
        rows, held = counted(rows.join(mixed.select("token"), "token", "left_semi"), "open")
        slots *= PIVOT_GROWTH
    return comps


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``comps`` (node, component) with the components that ``links`` (a, b) join put together."""
    if comps is not None:
        name = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        links = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    links, n = counted(links_of(links, "a", "b"), "verified")
    if not n:
        return comps
    found = contracted(links, n)
    if comps is None:
        return found
    f = found.select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = comps.join(f, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(moved.unionByName(found.join(comps, "node", "left_anti")), "components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id, class_size)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = frequency_sketch(rows, "text", words)
    wide = written(prefixes(rows, sketch, "doc_id", "text", words, percent), "prefixes")
    full = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # equal sets have equal prefixes and bitmaps, so a class takes any member's
    classes = wide.filter(full).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), *(F.first(c).alias(c) for c in ("l", "head", "bits")))
    classes = written(classes, "classes")
    # the long columns are held once, by the classes, and by nothing once the links are found
    table = written(wide.select("doc_id", "n", "d1", "d2"), "sets-of-rows")
    discard(wide)
    info = classes.select(F.col("rep").alias("id"), F.col("n").cast("int").alias("n"), "l", "head", "bits")

    def check(pairs: DataFrame) -> DataFrame:
        ids, n = counted(_ends(pairs), "ids")
        left, n = counted(sieve(pairs, thinned(info, id_filter(ids, n)), percent), "sieved")
        if not n:
            return left
        ids, n = counted(_ends(left), "ids")
        return verify(left, written(candidate_sets(rows, ids, n, "doc_id", "text", words), "sets"), percent)

    postings, held = shared_postings(info.select("id", "n", "head"))
    comps = link_components(postings, held, check, percent)
    names = written(classes.select("d1", "d2", "n", "rep", "class_size"), "names")
    discard(classes, postings)
    # an id of several texts belongs to several classes, which it links
    texts = table.filter(full).groupBy("doc_id").agg(*(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("d1", "d2")))
    texts, n = counted(texts.filter("mind1 != maxd1 OR mind2 != maxd2").select("doc_id"), "several")
    if n:
        own = table.filter(full).join(texts, "doc_id", "left_semi").select("doc_id", "d1", "d2", "n").join(names.drop("class_size"), ["d1", "d2", "n"])
        comps = merged(comps, own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct())
    if comps is not None:
        names = names.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        names = names.withColumn("component", F.col("rep"))
    names = names.filter((F.col("class_size") > 1) | (F.col("component") != F.col("rep")))
    some = table.filter(full).select("doc_id", "n", "d1", "d2").join(names, ["d1", "d2", "n"], "left")
    some = some.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
    none = table.filter(~full).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return some.unionByName(none)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
