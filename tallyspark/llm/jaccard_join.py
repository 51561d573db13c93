"""Size-aware heavy-light Jaccard join of n-gram sets, and the components of its links.

Sets that are equal are one set, named by its fingerprint.  Elements have a common order, rarest
first: by the class of their count in the corpus (those seen once are the first), then by hash.

Small sets meet over the fixed-size subsets they have in common: each lists its subsets of every
size that a partner may share, but for subsets with an element that nobody else has.  Large sets
meet on inverted lists over their rarest elements: any two linked sets share one of the first
``size - needed + 1`` elements of either; elements seen once get no list.

The boundary is the size up to which listing subsets costs less.  Both costs are counted over the
corpus's small sets, by size: a subset is a row; an element scanned is a row and a comparison with
the list's hub in each hub round, or with each other member if these are fewer.  No size is light
of which a set may have more than ``MOST_SUBSETS`` subsets.

Members of a list are not all paired.  First each is compared with the list's hub, the member
found on most lists, and linked members become one component; with more hub rounds, then with
another hub, of the largest component.  Only members of different
components are compared further, and of those only pairs whose 1024-bit parity bitmaps and unique
elements leave a link possible; both bounds are exact.  A list of more than ``SPLIT`` members is
split by size, as linked sets have sizes within the threshold of each other: a member goes to
its size's band and the next one.  Remaining pairs are verified on their texts.  So copies cost
a comparison each, a common element's list falls apart, and no link between components is lost.

Words fold A-Z.  A text with fewer than n words, but one at least, has its whole sequence as its
only element.  Null and wordless texts have no element and no link.  Very long texts are whole
sets.  A row with a null id is left out.  Rows that repeat an id count as one document: equal
texts are one set, others are linked through their id.  An empty table gives no row.  Columns
beside id and text don't matter, whatever their names.
"""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import Repeats, count_repeats
from .shared import row_of, written
from .textblocks import U, Words, grams, mix, per_document, signed, slices

BITS = 1024
SUBSET = U(0xA0761D6478BD642F)
MOST_SUBSETS, SPLIT = 2048, 64


def needed(p, a, b):
    """Least intersection of linked sets of sizes a and b, where 100 * i >= p * (a + b - i)."""
    return (p * (a + b) + 99 + p) // (100 + p)


def spare(p, size):
    """How many elements of a set a partner may lack; its prefix has one more."""
    return size - -(-p * size // 100)


def gram_sets(data, off, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) of the n-grams of a slice, sorted by document and hash."""
    w = Words(data, off, fold=True)
    h = w.hashes()
    g, valid = grams(h, w.doc, n)
    g, doc = g[valid], w.doc[: len(valid)][valid]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        whole = []
        for d in short:
            x = U(0)
            for y in h[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x]) * STEP_SHORT + y)[0]
            whole.append(x)
        g, doc = np.r_[g, np.array(whole, np.uint64)], np.r_[doc, short]
    return per_document(g, doc)


STEP_SHORT = U(0x2545F4914F6CDD1D)


def _all_grams(n):
    def hashes(batch):
        for _, _, data, off in slices(batch.column("text")):
            yield gram_sets(data, off, n)[0]

    return hashes


def subsets(p: int, size: int, alone: int = 0) -> int:
    """How many subsets a light set lists of which ``alone`` elements are nobody else's."""
    return sum(math.comb(size - alone, d - alone) for d in range(alone, spare(p, size) + 1))


def lightest(p: int) -> int:
    """The largest size whose sets have no more than MOST_SUBSETS subsets, 500 at most."""
    return next((s for s in range(1, 500) if subsets(p, s + 1) > MOST_SUBSETS), 500)


def light_boundary(rows: DataFrame, found, n: int, p: int, hub_rounds: int) -> int:
    """The size up to which sets are light: where the counted costs of both ways add up to least, over all sets that may be light.

    Texts of more than 40 characters for each element of such a set are taken to have larger ones.
    """
    most = lightest(p)

    def costs(batches):
        seen: Repeats = found.value
        total = np.zeros((2, most + 1), np.int64)
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                h, doc = gram_sets(data, off, n)
                size = np.bincount(doc, minlength=len(off) - 1)
                few = size[doc] <= most
                h, doc = h[few], doc[few]
                kind = seen.frequency_class(h)
                order = np.lexsort((h, kind, doc))
                kind, doc = kind[order], doc[order]
                first = np.searchsorted(doc, np.arange(len(off) - 1))
                place = np.arange(len(doc)) - first[doc]
                scanned = (place <= spare(p, size[doc])) & (kind > 0)
                # a class tells its list's length up to a factor of two
                length = 1 << np.minimum(np.maximum(kind - 1, 1), 20)
                np.add.at(total[1], size[doc[scanned]], 1 + np.minimum(length[scanned] - 1, hub_rounds))
                alone = np.bincount(doc[kind == 0], minlength=len(size))
                for s, k in zip(*np.unique(np.stack([size, alone])[:, (size > 0) & (size <= most)], axis=1), strict=True):
                    total[0, s] += subsets(p, int(s), int(k)) * int(((size == s) & (alone == k)).sum())
        yield pa.record_batch([pa.array(np.arange(most + 1)), pa.array(total[0]), pa.array(total[1])], ["size", "subsets", "scans"])

    short = rows.where(F.length("text") <= 40 * most).select("text").mapInArrow(costs, "size long, subsets long, scans long")
    by_size = np.zeros((2, most + 1), np.int64)
    # a row for each size that may be light
    for size, a, b in short.groupBy("size").agg(F.sum("subsets"), F.sum("scans")).collect():
        by_size[:, size] = a, b
    light = np.cumsum(by_size[0]) + by_size[1].sum() - np.cumsum(by_size[1])
    return int(light.argmin())


def _subsets(h: np.ndarray, alone: int, spare: int):
    """Hashes of the subsets of h that lack up to spare elements, the first ``alone`` of h among them."""
    m = mix(h ^ SUBSET)
    own = m[alone:]
    with np.errstate(over="ignore"):
        total = own.sum(dtype=np.uint64)
        out = [np.array([total])]
        for d in range(1, spare - alone + 1):
            out.append(total - own[np.array(list(combinations(range(len(own)), d)))].sum(axis=1, dtype=np.uint64))
    return mix(np.concatenate(out) + SUBSET)


SIGNED = "doc long, tkey long, n long, one long, two long, alone long, bitmap array<long>, keys array<long>"


def signatures(rows: DataFrame, n: int, p: int, hub_rounds: int = 1, report: dict | None = None) -> DataFrame:
    """A row for each of rows(doc, tkey, text): size, name and bitmap of its set, and the lists it is on."""
    shared = rows.sparkSession.sparkContext.broadcast(count_repeats(rows.select("text"), _all_grams(n), heavy_from=1 << 62))
    light = light_boundary(rows, shared, n, p, hub_rounds)
    if report is not None:
        report["light"] = light

    def sign(batches):
        seen: Repeats = shared.value
        for batch in batches:
            ids, tkey = batch.column("doc"), batch.column("tkey")
            for i, j, data, off in slices(batch.column("text"), 512 << 10):
                h, doc = gram_sets(data, off, n)
                docs = j - i
                size = np.bincount(doc, minlength=docs)
                kind = seen.frequency_class(h)
                bits = (np.bincount(doc * BITS + (h & U(BITS - 1)).astype(np.int64), minlength=docs * BITS) & 1).astype(np.uint8)
                bitmap = np.packbits(bits, bitorder="little").view(np.int64)
                prints = np.zeros((2, docs), np.uint64)
                edges = np.searchsorted(doc, np.arange(docs + 1))
                if len(h):
                    for k in range(2):
                        prints[k, size > 0] = np.add.reduceat(mix(h + U(k + 1) * STEP_SHORT), edges[:-1][size > 0])
                order = np.lexsort((h, kind, doc))
                h, kind = h[order], kind[order]
                rank = np.arange(len(h)) - edges[doc]
                keep = (rank <= spare(p, size[doc])) & (100 * size[doc] > p * light) & (kind > 0)
                keys, cuts = signed(h[keep]), np.searchsorted(doc[keep], np.arange(docs + 1))
                alone = np.bincount(doc[kind == 0], minlength=docs)
                each = [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for d in np.flatnonzero((size > 0) & (size <= light) & (alone <= spare(p, size))):
                    each[d] = np.r_[each[d], signed(_subsets(h[edges[d] : edges[d + 1]], int(alone[d]), int(spare(p, size[d]))))]
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *each])
                yield pa.record_batch(
                    [
                        ids.slice(i, docs), tkey.slice(i, docs), pa.array(size), pa.array(signed(prints[0])), pa.array(signed(prints[1])), pa.array(alone),
                        pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * (BITS // 64)), pa.array(bitmap)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    ["doc", "tkey", "n", "one", "two", "alone", "bitmap", "keys"],
                )

    return written(rows.mapInArrow(sign, SIGNED))


def _possible(p: int):
    """Whether sets x and y can be linked, from sizes, unique elements and parity bitmaps."""
    need = F.floor((p * (F.col("x.n") + F.col("y.n")) + 99 + p) / (100 + p))
    differ = sum((F.bit_count(F.col("x.bitmap")[i].bitwiseXOR(F.col("y.bitmap")[i])) for i in range(BITS // 64)), F.lit(0))
    return (F.least(F.col("x.n") - F.col("x.alone"), F.col("y.n") - F.col("y.alone")) >= need) & (differ <= F.col("x.n") + F.col("y.n") - 2 * need)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, p: int) -> DataFrame:
    """Those of pairs(a, b) whose sets link."""
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("y")), "b")

    def check(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for i, j, data, off in slices(batch.column("x"), 512 << 10):
                k, start = j - i, i
                y = batch.column("y").slice(start, k)
                hx, dx = gram_sets(data, off, n)
                parts = [(gram_sets(d2, o2, n), s) for s, _, d2, o2 in slices(y, 512 << 10)]
                hy, dy = np.concatenate([q[0][0] for q in parts]), np.concatenate([q[0][1] + q[1] for q in parts])
                h, d = np.r_[hx, hy], np.r_[dx, dy]
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=k)
                total = np.bincount(d, minlength=k)
                ok = pa.array((100 * both >= p * (total - both)) & (both > 0))
                yield pa.record_batch([a.slice(start, k).filter(ok), b.slice(start, k).filter(ok)], ["a", "b"])

    return written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def _lists(first: DataFrame, p: int) -> DataFrame:
    """key, sid: lists of two members or more; those of more than SPLIT members split by size."""
    # a set of band b links with sets of the bands b - 1 to b + 1 only; a little wider than the threshold, so that rounding can't part two
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / p) * (1 + 1e-6))).cast("long") if p < 100 else F.col("n")
    lists = written(first.where(F.size("keys") > 0).select("sid", band.alias("band"), F.explode(F.array_distinct("keys")).alias("key")))
    length = lists.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    met = lists.join(length, "key")
    apart = F.when(F.col("length") <= SPLIT, F.array("key")).otherwise(F.transform(F.sequence("band", F.col("band") + 1), lambda b: F.xxhash64("key", b)))
    return met.select("sid", F.explode(apart).alias("key"))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, hub_rounds: int = 1, report: dict | None = None) -> DataFrame:
    """A row for each id: doc, n_shingles, component (the smallest id that links lead to, itself included).

    report, if given, gets the boundary (light), and how many list entries, candidate pairs and links there were.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    sid = F.when(F.col("n") > 0, F.xxhash64("one", "two")).alias("sid")
    signed_docs = signatures(rows, n, percent, hub_rounds, report)
    first = signed_docs.where("n > 0").groupBy(sid).agg(F.min(F.struct("doc", "tkey", "n", "alone", "bitmap", "keys")).alias("s")).select("sid", "s.*")
    first = written(first.withColumn("keys", F.when(F.col("n") - F.col("alone") >= F.ceil(F.col("n") * percent / 100), F.col("keys")).otherwise(F.expr("cast(array() as array<long>)"))))
    occ = _lists(first, percent)
    occ = written(occ.join(occ.groupBy("sid").agg(F.count("*").alias("lists")), "sid"))
    listed = written(first.join(occ.select("sid").distinct(), "sid").select("sid", "doc", "tkey", F.struct("n", "alone", "bitmap").alias("facts")))
    texts = written(rows.join(listed.select("sid", "doc", "tkey"), ["doc", "tkey"]).select("sid", "text").dropDuplicates(["sid"]))
    a, b = (listed.select(F.col("sid").alias(c), F.col("facts").alias(f)) for c, f in (("a", "x"), ("b", "y")))

    def note(name, pairs):
        if report is not None:
            report[name] = pairs.count()

    note("entries", occ)
    links = None
    for k in range(hub_rounds):
        if links is None:
            open_lists = occ.withColumn("component", F.col("sid")).withColumn("weight", F.lit(1)).withColumn("turn", F.col("lists"))
        else:
            # another hub than before, of the largest component
            open_lists = _mixed(occ, components(links)).withColumn("turn", F.xxhash64("sid", F.lit(k)))
        hubs = open_lists.groupBy("key").agg(F.max(F.struct("weight", "turn", "sid", "component")).alias("h")).select("key", F.col("h.sid").alias("hub"), F.col("h.component").alias("of"))
        pairs = open_lists.join(hubs, "key").where("component <> of").select(F.greatest("sid", "hub").alias("a"), F.least("sid", "hub").alias("b")).distinct()
        pairs = pairs.join(a, "a").join(b, "b").where(_possible(percent)).select("a", "b")
        new = _verified(pairs, texts, n, percent)
        note(f"hub pairs {k + 1}", pairs)
        links = new if links is None else links.union(new)
    rest = written(_mixed(occ, components(links)).join(listed, "sid"))
    one = rest.select("key", F.col("sid").alias("a"), F.col("component").alias("ca"), F.col("facts").alias("x"))
    two = rest.select("key", F.col("sid").alias("b"), F.col("component").alias("cb"), F.col("facts").alias("y"))
    pairs = one.join(two, "key").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _possible(percent)).select("a", "b").distinct()
    links = links.union(_verified(pairs, texts, n, percent))
    note("last pairs", pairs)
    note("links", links)
    # an id with different texts joins their sets
    same_id = signed_docs.where("n > 0").select("doc", sid).groupBy("doc").agg(F.min("sid").alias("b"), F.max("sid").alias("least")).where("b <> least")
    same_id = same_id.join(signed_docs.where("n > 0").select("doc", sid.alias("a")), "doc").where("a <> b").select("a", "b")
    names = first.select("sid", "doc").join(components(links.union(same_id)).withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = names.groupBy("component").agg(F.min("doc").alias("least"))
    names = names.join(least, "component").select("sid", "least")
    out = signed_docs.select("doc", "n", sid).join(names, "sid", "left")
    return out.groupBy("doc").agg(F.max("n").alias("n_shingles"), F.coalesce(F.min("least"), F.col("doc")).alias("component"))


def _mixed(occ: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that still hold several components; weight: members of the component."""
    weight = labels.groupBy("component").agg(F.count("*").alias("weight"))
    named = occ.join(labels.join(weight, "component").withColumnRenamed("node", "sid"), "sid", "left")
    named = named.select("key", "sid", "lists", F.coalesce("component", "sid").alias("component"), F.coalesce("weight", F.lit(1)).alias("weight"))
    mixed = named.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    return written(named.join(mixed, "key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of the smallest id of each component, one of its equal rows, and rows with a null id.

    Of rows that repeat the id kept with other texts, that of the least text hash stays.
    """
    found = linked_documents(docs, id_col, text_col, n, percent).where("doc <> component").select(F.col("doc").alias("_gone"))
    kept = docs.join(found, docs[id_col].cast("long") == found["_gone"], "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_id")
    twice = written(twice)
    if twice.isEmpty():
        return kept
    same = kept[id_col].cast("long") == twice["_id"]
    row = row_of(docs.columns)
    some = kept.join(twice, same, "left_semi").groupBy(F.col(id_col).cast("long")).agg(F.min_by(row, F.struct(F.xxhash64(text_col), F.to_json(row))).alias("_row"))
    return kept.join(twice, same, "left_anti").unionByName(some.select("_row.*"))


__all__ = ["linked_documents", "one_of_each", "needed"]
