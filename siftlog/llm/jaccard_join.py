"""N-gram Jaccard join by grouped prefixes: classes of documents whose word-shingle sets overlap enough.

1. Document frequencies of all shingles are counted over all documents (``packed``); a document's shingles are
   ordered by frequency, then identifier. Two sets that link share a shingle within their prefixes, the first
   ``n - ceil(share * n) + 1`` of them.
2. Documents with identical prefixes and size collapse into one group; prefix shingles found in one document
   only are left out of the index.
3. Group pairs that share a prefix shingle pass a size and a position filter, then are expanded to members and
   verified on the whole sets. To avoid all pairs of a large class, each index entry first verifies its members
   against one hub, the member with the fewest shingles of its own, and the links' components are found;
   afterwards only pairs of members in *different* components are expanded and verified. Pairs inside a component can't change the classes, so none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm import packed
from siftlog.llm.bytetext import LOWER, U, give_back, mix, shingle_sets, spans
from siftlog.llm.components import components
from siftlog.llm.shared import chunks_for, saved
from siftlog.llm.standing import answered, at_level, stand, standing_texts

BITS = 44
#: Of an indexed shingle, how many of the indexed ones before it are kept beside it.
BEFORE = 8
INDEXED = "digest string, doc_id long, n int, own int, prefix_key long, shingles array<long>, places array<int>, members binary"


def _fits(num: int, den: int) -> Column:
    """Size filter, and the most that two sets can share once places p and q hold the same shingle.

    The ``own`` shingles that no other document has stand first and can't be shared: before the places at most
    the others match, and after them at most what is left of either.
    """
    n, m, p, q = (F.col(c) for c in ("x_n", "y_n", "x_place", "y_place"))
    most = F.least(p - F.col("x_own"), q - F.col("y_own")) + F.least(n - p, m - q)
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * most >= num * (n + m))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets, sorted 64-bit identifiers, have den * shared >= num * united."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(m := pa.array(ok, pa.bool_())), batch["b"].filter(m)], ["a", "b"])
        give_back()

    held = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Return doc_id, n_shingles and component_id (the least doc_id that links reach, itself included).

    Words are maximal runs of characters other than ASCII white space after A-Z are lower-cased; a set holds the
    distinct ``size``-word shingles, or the whole sequence if it is shorter; two documents link when
    ``den * shared >= num * united``. Without words or text a set is empty and links with nothing, also not with
    another empty one. Repeated rows are each returned, in their class. Rows with a null id take part only
    through equal texts; they return with a null id. An empty table gives an empty result.
    """
    held = stand(docs, id_col, text_col, chunk_bytes, "jaccard")
    parts = chunks_for(held.total // 8, 1 << 20)

    def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, out = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in spans(offsets):
            bounds, h = shingle_sets(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], size)
            ends.append(bounds[1:] + ends[-1][-1])
            out.append(h)
        return np.concatenate(ends), np.concatenate(out)

    def count(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, data, offsets = standing_texts(left, right)
        give_back()
        return packed.sent(key[0].as_py(), sets_of(data, offsets)[1], BITS, parts)

    def index(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own, data, offsets = standing_texts(left, right)
        give_back()
        bounds, h = sets_of(data, offsets)
        often = packed.answers(h, BITS, at_level(right, 0))
        rows = []
        for k, (digest, doc, _) in enumerate(own):
            s, f = h[bounds[k] : bounds[k + 1]], often[bounds[k] : bounds[k + 1]]
            n = len(s)
            first = np.lexsort((s, f))[: n - -(-num * n // den) + 1] if n else np.zeros(0, np.int64)
            found = np.flatnonzero(f[first] > 1)
            link = len(found) > 0
            name = mix(np.cumsum(mix(s[first] + np.arange(len(first), dtype=U))))[-1:].view(np.int64) if link else [0]
            rows.append((digest, doc, n, int((f < 2).sum()), int(name[0]), s[first[found]].view(np.int64).tolist() if link else None, found.tolist() if link else None, s.tobytes() if link else None))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in INDEXED.split(", ")])

    sent = held.texts.groupBy("chunk").cogroup(held.side.groupBy("chunk")).applyInArrow(count, packed.SENT)
    side = held.side.unionByName(answered(packed.counted(sent), 0))
    indexed = saved(held.texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(index, INDEXED), "jaccard-index")

    active = indexed.where(F.col("shingles").isNotNull() & F.col("doc_id").isNotNull())
    groups = active.groupBy("n", "prefix_key").agg(F.min("doc_id").alias("group"))
    grouped = saved(active.select("doc_id", "n", "prefix_key").join(groups, ["n", "prefix_key"]).select("doc_id", "group", "n"), "jaccard-groups")
    entries = active.join(grouped.select("group").distinct(), F.col("doc_id") == F.col("group"), "left_semi")
    entries = entries.select(F.col("doc_id").alias("group"), "n", "own", "shingles", F.posexplode(F.arrays_zip("shingles", "places")).alias("i", "e"))
    earlier = F.slice("shingles", F.greatest(F.col("i") - (BEFORE - 1), F.lit(1)), F.least(F.col("i"), F.lit(BEFORE)))
    entries = entries.select("group", "n", "own", F.col("e.shingles").alias("shingle"), F.col("e.places").alias("place"), earlier.alias("earlier"))
    entries = saved(entries, "jaccard-entries")
    sets = active.select("doc_id", "members")

    # Each entry's members against its hub, and each group's members against the one that names it.
    hub = F.min_by(F.struct(F.col("group").alias("y"), F.col("n").alias("y_n"), F.col("own").alias("y_own"), F.col("place").alias("y_place")), F.struct("own", F.xxhash64("group"), "group"))
    hubs = entries.groupBy("shingle").agg(hub.alias("h"), F.count("*").alias("size")).where("size > 1").select("shingle", "h.*")
    stars = entries.select("shingle", F.col("group").alias("x"), F.col("n").alias("x_n"), F.col("own").alias("x_own"), F.col("place").alias("x_place")).join(hubs, "shingle").where((F.col("x") != F.col("y")) & _fits(num, den))
    stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(grouped.where("doc_id <> group").select("group", "doc_id")).distinct()
    stars = saved(stars, "jaccard-stars")
    links = saved(verified(stars, sets, num, den), "jaccard-links")
    labels = components(links)

    # What remains: pairs in one entry, in different components, that no hub has tried.
    held_by = grouped.join(labels, F.col("doc_id") == F.col("v"), "left").select("doc_id", "group", F.coalesce("label", "doc_id").alias("label"))
    spread = entries.join(held_by, "group").select("shingle", "place", "n", "own", "doc_id", "label", "earlier", F.xxhash64("earlier").alias("mark"))
    # Alike members (component, size, own shingles, place, shingles before) stand together until a pair of such kinds
    # passes the filters. A pair is left to an earlier entry if the shingles just before share one; its first stays.
    kind = ["shingle", "label", "n", "own", "place", "mark"]
    kinds = spread.groupBy(*kind).agg(F.any_value("earlier").alias("earlier"))
    side_of = lambda df, s: df.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "shingle"])
    # Where all indexed shingles before both places are at hand, none before is shared: at most what follows is.
    whole = (F.col("x_place") - F.col("x_own") <= BEFORE) & (F.col("y_place") - F.col("y_own") <= BEFORE)
    after = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    first = ~F.arrays_overlap("x_earlier", "y_earlier") & (~whole | ((num + den) * after >= num * (F.col("x_n") + F.col("y_n"))))
    apart = side_of(kinds, "x").join(side_of(kinds, "y"), "shingle").where((F.col("x_label") < F.col("y_label")) & _fits(num, den) & first).drop("x_earlier", "y_earlier")
    named = spread.withColumnRenamed("doc_id", "doc").drop("earlier")
    rest = apart.join(side_of(named, "x"), ["shingle", *[f"x_{c}" for c in kind[1:]]]).join(side_of(named, "y"), ["shingle", *[f"y_{c}" for c in kind[1:]]])
    rest = rest.withColumnsRenamed({"x_doc": "x", "y_doc": "y"})
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = saved(rest, "jaccard-rest")
    late = saved(verified(rest, sets, num, den), "jaccard-late")
    if late.limit(1).count():
        labels = components(labels.where("v <> label").select(F.col("label").alias("a"), F.col("v").alias("b")).union(late))

    own = indexed.select("digest", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("stand"))
    own = own.join(labels.select(F.col("v").alias("stand"), "label"), "stand", "left")
    out = held.members.join(own, "digest")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("label", "stand")).alias("component_id"))
