"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. Texts with equal shingle sets become one class, known by a 64-bit digest of the set.
2. Similar classes are partitioned into groups: classes that share one of a few minimum hashes are compared with one
   representative each; groups are the connected components at a low similarity, and cores within them those at the
   threshold. Thousands of near copies thus cost a comparison or two each. A class without a neighbour is a group by itself.
3. The matrix stores each group's token union, with the number of members that have each token, in slices of bounded size
   (a group of one class is its own union). Two bounds come from it:
   - Within a group, no other member can share a token that only one member has. A class with less than the threshold's
     share of tokens that two members or more have can't link to any other member and is done.
   - Between groups, a class can't link to a member of a group whose union holds less than the threshold's share of its
     tokens. Which pairs of groups may reach it is found by prefix keys: pairs of tokens that are neighbours in a set's
     hash order. Each token in which two sets differ breaks at most two of them, so two sets at or above the threshold
     share at least (2t - 1) n of the n - 1 keys of the larger one, and by prefix filtering under any common order of keys
     they share one within the first 2 (1 - t) n keys of the larger and 3 (1 - t) / (1 + t) n of the smaller. For groups
     that share such a key, the classes of the one with fewer members are queries to the other, and each query's overlap
     with the union is counted.
4. Only groups that qualify are opened, and their members compared with the query exactly. Within a group, the classes
   that are left outside its largest core are compared with the members left in other cores, in blocks of bounded size;
   pairs within a core need no further work, since only connections are asked for.

Every link between different components is found, whatever the grouping was; grouping and the order of keys only decide
how much work it takes. A passage that many texts share rarely makes two neighbours in both of two texts, and keys of two
tokens that a sample shows to be frequent come last in the order. What stays quadratic: classes of one group that share
almost enough tokens with each other, and texts of different groups that consist mostly of the same passages. Postings
travel as packed arrays, one row for each task and bucket of keys; keys of frequent tokens, the only ones that a large
share of all texts can have in common, are dealt by their class instead, so no bucket holds all of such a key's postings.

Defined cases: texts without words (null ones too) have no shingles and link with nothing; with fewer words than the
width the whole sequence is the one shingle; repeated rows are one class and each returned; a null id links others but
isn't a component's name unless all ids are null; very long texts are read whole, in parts of bounded size; a pair of
just the threshold is linked; an empty table gives no rows; other columns are ignored. Set digests and shingle hashes
have 64 bits, so n distinct sets collide with probability n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship, temporaries, tidy
from .bitmap import bitmap_of, rows_that_may_hold
from .graph import components
from .shingles import STEP, mix, shingle_sets

WIDTH, THRESHOLD_PERCENT = 5, 75
KEYS = 6
SAMPLE_TEXTS, FREQUENT_TOKENS, FREQUENT_COUNT = 16_384, 1 << 16, 3
BUCKET_POSTINGS, FLUSH_POSTINGS = 500_000, 1_000_000
GROUP_PERCENT, QUERY_BLOCK, MEMBER_BLOCK = 35, 512, 2048
SLICE_TOKENS, ASKED_TOKENS, COPIES = 500_000, 8192, 4
NO_ID = (1 << 63) - 1  # stands for a null id: the last to name a component

_ODD = [np.uint64(2 * x + 1) for x in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x106689D45497FDB5, 0x3C6EF372FE94F82A, 0x27220A95F3A1B7C9)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, dtype=np.int64)


def _digests(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit digest of each set that isn't empty."""
    full = sizes > 0
    sums = np.add.reduceat(mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), _starts(sizes)[full]) if full.any() else np.zeros(0, dtype=np.uint64)
    return mix(sums + sizes[full].astype(np.uint64)).view(np.int64)


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, cid, keys): the digest of each text's shingle set and its minimum hashes."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, end, tokens, sizes in shingle_sets(batch.column(1), width):
                full = np.flatnonzero(sizes)
                cids = np.zeros(end - first, dtype=np.int64)
                keys = np.zeros((len(full), KEYS), dtype=np.uint64)
                if len(full):
                    cids[full] = _digests(tokens, sizes)
                    for i in range(KEYS):
                        keys[:, i] = np.minimum.reduceat(tokens * _ODD[i], _starts(sizes)[full])
                has = sizes > 0
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(has * KEYS))).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(sizes), pa.array(cids, mask=~has), lists], names=["doc_id", "n_shingles", "cid", "keys"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, cid long, keys array<long>")


def _sets_of(docs: DataFrame, width: int, bits: Broadcast) -> DataFrame:
    """(cid, tokens) of the texts that have words and whose ids pass a bitmap."""

    def run(batches):
        for batch in batches:
            picked = batch.filter(pa.array(bits.value.may_hold(batch.column(0).to_numpy(zero_copy_only=False))))
            for _, _, tokens, sizes in shingle_sets(picked.column(1), width):
                full = np.flatnonzero(sizes)
                at = _starts(sizes)
                blobs = [tokens[at[i] : at[i] + sizes[i]].tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(tokens, sizes)), pa.array(blobs, pa.binary())], names=["cid", "tokens"])

    return docs.mapInArrow(run, "cid long, tokens binary")


def fetch_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, tokens) of the classes in the column cid of `wanted`, and of a few others."""
    needed = materialize(wanted.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select("rep"), "needed")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed))
    return materialize(_sets_of(docs.select("doc_id", "text"), width, bits).dropDuplicates(["cid"]), "sets", codec="none")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("cid"))


def compare(pairs: DataFrame, sets: DataFrame, percent: int, low: int | None = None) -> DataFrame:
    """Those of the pairs (u, v) of class ids with a Jaccard similarity of low percent or more, and if it reaches percent."""
    left = pairs.join(sets.select(F.col("cid").alias("u"), F.col("tokens").alias("x")), "u")
    both = left.join(sets.select(F.col("cid").alias("v"), F.col("tokens").alias("y")), "v").select("u", "v", "x", "y")
    least = percent if low is None else low

    def run(batches):
        for batch in batches:
            keep, linked = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= least * (len(a) + len(b) - common)
                linked[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["u", "v", "linked"]).filter(pa.array(keep))

    return both.mapInArrow(run, "u long, v long, linked boolean")


def block_links(queries: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of classes (cid, core, tokens) of different cores, one from each list, by an index of the members' tokens."""
    sizes = np.array([len(tokens) for _, _, tokens in members])
    tokens = np.concatenate([tokens for _, _, tokens in members])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(members)), sizes)[order]
    cids, cores = np.array([cid for cid, _, _ in members]), np.array([core for _, core, _ in members])
    out = []
    for cid, core, own in queries:
        low = np.searchsorted(tokens, own, side="left")
        count = np.searchsorted(tokens, own, side="right") - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(members))
        hit = (100 * common >= percent * (len(own) + sizes - common)) & (cores != core)
        out += [(cid, int(other)) for other in cids[hit]]
    return out


def slice_edges(tokens: np.ndarray, slices: int) -> Iterator[tuple[int, int, int]]:
    """(slice, first, end) of the parts of sorted tokens, dealt to so many slices by their first bits."""
    at = (tokens >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(at[low]), low, high


def token_union(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of the parts together; a part without counts is a set."""
    tokens = np.concatenate([t for t, _ in parts])
    counts = np.concatenate([np.ones(len(t), dtype=np.int64) if n is None else n.astype(np.int64) for t, n in parts])
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, dtype=np.int64)
    return tokens[first], np.add.reduceat(counts, first) if len(first) else counts


def _matrix(sets: DataFrame) -> DataFrame:
    """The token unions (group, slice, slices, tokens, counts) of the sets (cid, tokens, group, n) of groups.

    Every task adds up what it has of a group first, so a slice gets a row from each task, however many members there are.
    """
    sliced = sets.groupBy("group").agg(F.ceil(F.sum("n") / SLICE_TOKENS).alias("slices"))
    sliced = materialize(sliced, "slices")  # a join of tables, so that Spark can split a large group

    def add_up(batches):
        held: dict[tuple[int, int, int], list] = {}
        size = 0

        def flush():
            keys, made = list(held), [token_union(held[key]) for key in held]
            held.clear()
            columns = [pa.array([key[i] for key in keys], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.tobytes() for t, _ in made], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in made], pa.binary())], names=["group", "slices", "slice", "tokens", "counts"])

        for batch in batches:
            for group, slices, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = np.frombuffer(blob.as_py(), dtype=np.uint64)
                for place, low, high in slice_edges(tokens, slices):
                    held.setdefault((group, slices, place), []).append((tokens[low:high], None))
                size += len(tokens)
                if size >= FLUSH_POSTINGS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = token_union([(np.frombuffer(t, dtype=np.uint64), np.frombuffer(n, dtype="<u4")) for t, n in zip(frame["tokens"], frame["counts"], strict=True)])
        return pd.DataFrame([{"group": frame["group"].iloc[0], "slices": frame["slices"].iloc[0], "slice": frame["slice"].iloc[0], "tokens": tokens.tobytes(), "counts": counts.astype("<u4").tobytes()}])

    schema = "group long, slices long, slice long, tokens binary, counts binary"
    added = sets.join(sliced, "group").select("group", "slices", "tokens").mapInArrow(add_up, schema)
    return materialize(added.groupBy("group", "slice").applyInPandas(run, schema), "unions", codec="none")


def _overlaps(asked: DataFrame, unions: DataFrame, shared: bool) -> DataFrame:
    """(group, cid, overlap): how many tokens of each query asked (cid, group, tokens) the group's union has; with `shared`,
    only those count that two members or more have.

    Queries meet a slice of the union in blocks of bounded size; a slice is copied to few enough blocks that it isn't more
    than COPIES times what the queries bring.
    """
    sliced = unions.select("group", "slices").distinct()

    def cut(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for group, slices, cid, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                tokens = np.frombuffer(blob.as_py(), dtype=np.uint64)
                for place, low, high in slice_edges(tokens, slices):
                    for column, value in zip(out, (group, place, cid, tokens[low:high].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["group", "slice", "cid", "tokens"])

    parts = asked.join(sliced, "group").select("group", "slices", "cid", "tokens").mapInArrow(cut, "group long, slice long, cid long, tokens binary")
    brought = parts.groupBy("group", "slice").agg((F.sum(F.octet_length("tokens")) / 8).alias("brought"))
    fair = F.least(F.ceil(F.col("brought") / ASKED_TOKENS), COPIES * F.ceil(F.col("brought") * 8 / F.octet_length("tokens")))
    blocks = materialize(unions.join(brought, ["group", "slice"]).select("group", "slice", F.greatest(F.lit(1), fair).cast("int").alias("blocks")), "query-blocks")
    queries = parts.join(blocks, ["group", "slice"]).select("group", "slice", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), "cid", "tokens", F.lit(None).cast("binary").alias("counts"))
    held = unions.join(blocks, ["group", "slice"]).select("group", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("long").alias("cid"), "tokens", "counts")  # no null, which pandas would make floating numbers of

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_query = frame["counts"].isna()
        union = np.zeros(0, dtype=np.uint64)
        for tokens, counts in zip(frame["tokens"][~is_query], frame["counts"][~is_query], strict=True):
            union = np.frombuffer(tokens, dtype=np.uint64)
            union = union[np.frombuffer(counts, dtype="<u4") > 1] if shared else union
        blobs = frame["tokens"][is_query]
        tokens = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        found = union[np.minimum(np.searchsorted(union, tokens), len(union) - 1)] == tokens if len(union) else np.zeros(len(tokens), dtype=bool)
        owner = np.repeat(np.arange(len(blobs)), [len(blob) // 8 for blob in blobs])
        overlap = np.bincount(owner, weights=found, minlength=len(blobs)).astype(np.int64)
        return pd.DataFrame({"group": frame["group"][is_query].to_numpy(np.int64), "cid": frame["cid"][is_query].to_numpy(np.int64), "overlap": overlap})

    counted = queries.unionByName(held).groupBy("group", "slice", "block").applyInPandas(run, "group long, cid long, overlap long")
    return counted.groupBy("group", "cid").agg(F.sum("overlap").alias("overlap"))


def _links_within(members: DataFrame, sets: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different cores of the same group; members has (cid, group, core, n)."""
    several = members.groupBy("group").agg(F.min("core").alias("least"), F.max("core").alias("most")).where("least <> most").select("group")
    several = materialize(several, "several-cores")
    asked = sets.join(several, "group")
    common = _overlaps(asked, unions.join(several, "group", "left_semi"), shared=True).select("cid", "overlap")
    members = materialize(members.join(common, "cid").where(F.col("overlap") * 100 >= F.col("n") * percent).select("cid", "group", "core"), "members-left")
    sets = sets.select("cid", "tokens")
    cores = members.groupBy("group", "core").agg(F.count(F.lit(1)).alias("size"))
    groups = cores.groupBy("group").agg(F.max_by("core", F.struct("size", "core")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most")).where(F.col("all") > F.col("most"))
    groups = groups.select("group", "largest", F.ceil((F.col("all") - F.col("most")) / QUERY_BLOCK).alias("query_blocks"), F.ceil(F.col("all") / MEMBER_BLOCK).alias("member_blocks"))
    groups = materialize(groups, "group-sizes")  # a join of two tables, so that Spark can split a large group
    rows = members.join(groups, "group").join(sets, "cid")
    mixed = lambda name: F.pmod(F.xxhash64("cid"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    queries = rows.where("core <> largest").select("group", mixed("query_blocks").alias("q"), every("member_blocks").alias("m"), F.lit(True).alias("is_query"), "cid", "core", "tokens")
    others = rows.select("group", every("query_blocks").alias("q"), mixed("member_blocks").alias("m"), F.lit(False).alias("is_query"), "cid", "core", "tokens")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts: tuple[list, list] = ([], [])
        for is_query, cid, core, tokens in zip(frame["is_query"], frame["cid"], frame["core"], frame["tokens"], strict=True):
            parts[int(is_query)].append((cid, core, np.frombuffer(tokens, dtype=np.uint64)))
        found = block_links(parts[1], parts[0], percent) if parts[0] and parts[1] else []
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return queries.unionByName(others).groupBy("group", "q", "m").applyInPandas(run, "u long, v long")


def _size_bound(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _named_pairs(classes: DataFrame, low: int) -> DataFrame:
    """Pairs (u, v) of classes and the representative of those that share a minimum hash with them."""
    keyed = classes.select("cid", "n", F.posexplode("keys").alias("i", "key"))
    named = keyed.groupBy("i", "key").agg(F.min(F.struct("cid", "n")).alias("named"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = keyed.join(named, ["i", "key"]).where((F.col("cid") != F.col("named.cid")) & _size_bound("n", "named.n", low))
    return materialize(pairs.select(F.col("cid").alias("u"), F.col("named.cid").alias("v")).distinct(), "near-pairs")


def _frequent_tokens(docs: DataFrame, count: int, width: int) -> np.ndarray:
    """Tokens that many texts share, sorted, by their counts in a sample of about SAMPLE_TEXTS texts.

    A bounded estimate is enough: it only moves tokens in the common order, which decides the work and not the result.
    """
    part = max(1, count // SAMPLE_TEXTS)
    buckets = 32

    def gather(batches):
        for batch in batches:
            for _, _, tokens, _ in shingle_sets(batch.column(1), width):
                at = (tokens % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(buckets + 1))
                tokens = tokens[order]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(buckets)), "tokens": [tokens[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

    def tally(frame: pd.DataFrame) -> pd.DataFrame:
        found, counts = np.unique(np.frombuffer(b"".join(frame["tokens"]), dtype=np.uint64), return_counts=True)
        often = counts >= FREQUENT_COUNT
        return pd.DataFrame({"token": found[often].view(np.int64), "texts": counts[often].astype(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    rows = sample.mapInArrow(gather, "bucket long, tokens binary").groupBy("bucket").applyInPandas(tally, "token long, texts long")
    top = rows.orderBy(F.desc("texts"), "token").limit(FREQUENT_TOKENS).toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def prefix_lengths(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in the probe prefix, keys in the index prefix) of sets of these sizes."""
    probe = 2 * sizes * (100 - percent) // 100 + 1
    index = 3 * sizes * (100 - percent) // (100 + percent) + 1
    return np.minimum(probe, sizes - 1), np.minimum(index, sizes - 1)


def neighbour_keys(tokens: np.ndarray, sizes: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, is in the index prefix) of the probe prefixes of sets whose sorted tokens follow one another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    keys, owner = mix(tokens[inner] * STEP + tokens[inner + 1]), owner[inner]
    late = np.zeros(len(keys), dtype=bool)
    if len(frequent) and len(keys):
        often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        late = often[inner] & often[inner + 1]
    keys = (keys & np.uint64((1 << 63) - 1)) | late.astype(np.uint64) << np.uint64(63)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    counts = np.bincount(owner, minlength=len(sizes))
    rank = np.arange(len(keys)) - np.repeat(_starts(counts), counts)
    probe, index = prefix_lengths(sizes, percent)
    keep = rank < probe[owner]
    return keys[keep], owner[keep], rank[keep] < index[owner[keep]]


class _Packer:
    """Collects postings and yields them as a row of packed arrays for each bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, keys: np.ndarray, index: np.ndarray, cids: np.ndarray, groups: np.ndarray | None = None):
        self.held.append((keys, index, cids, cids[:0] if groups is None else groups))
        self.size += len(keys)
        if self.size >= FLUSH_POSTINGS:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        keys, index, cids, groups = (np.concatenate(part) for part in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        # Keys of frequent tokens have the first bit: they go to buckets after the others, by their class.
        late = keys >> np.uint64(63) > 0
        at = np.where(late, self.buckets + (mix(cids.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64), ((keys >> np.uint64(39)) % np.uint64(self.buckets)).astype(np.int64))
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(2 * self.buckets + 1))
        short = ((keys & np.uint64((1 << 39) - 1)) << np.uint64(1) | index.astype(np.uint64))[order]
        packed = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        cids, groups = cids[order], groups[order] if len(groups) else None
        full = [i for i in range(2 * self.buckets) if edges[i] < edges[i + 1]]
        cut = lambda values: [values[edges[i] : edges[i + 1]].tobytes() for i in full]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "keys": cut(packed), "cids": cut(cids), "groups": pa.array([None] * len(full) if groups is None else cut(groups), pa.binary())})


_PACKED = "bucket long, keys binary, cids binary, groups binary"


def _shared_keys(docs: DataFrame, grouped_sets: DataFrame, buckets: int, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, group, cid, is_index) for prefix keys that classes of more than one group have, and for frequent ones.

    Every class emits its keys as a group of its own; those of larger groups (cid, tokens, group) emit them again with
    the group's name, which counts.
    """

    def alone(batches):
        packer, seen = _Packer(buckets), set()
        for batch in batches:
            for _, _, tokens, sizes in shingle_sets(batch.column(1), width):
                digests, sizes = _digests(tokens, sizes), sizes[sizes > 0]
                fresh = np.array([not (d in seen or seen.add(d)) for d in digests.tolist()], dtype=bool)
                if len(seen) > 200_000:
                    seen.clear()
                tokens, sizes, digests = tokens[np.repeat(fresh, sizes)], sizes[fresh], digests[fresh]
                keys, owner, index = neighbour_keys(tokens, sizes, percent, frequent)
                yield from packer.add(keys, index, digests[owner])
        yield from packer.flush()
        tidy()

    def together(batches):
        packer = _Packer(buckets)
        for batch in batches:
            for cid, tokens, group in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                keys, _, index = neighbour_keys(own, np.array([len(own)]), percent, frequent)
                yield from packer.add(keys, index, np.full(len(keys), cid, dtype=np.int64), np.full(len(keys), group, dtype=np.int64))
        yield from packer.flush()

    def runs(frame: pd.DataFrame) -> pd.DataFrame:
        packed = np.frombuffer(b"".join(frame["keys"]), dtype=np.uint8).reshape(-1, 5)
        keys = np.zeros((len(packed), 8), dtype=np.uint8)
        keys[:, :5] = packed
        keys = keys.reshape(-1).view("<u8")
        index, keys = (keys & np.uint64(1)).astype(bool), (keys >> np.uint64(1)).astype(np.int64)
        cids = np.frombuffer(b"".join(frame["cids"]), dtype=np.int64)
        own = frame["groups"].isna()
        named = np.repeat(~own.to_numpy(), [len(c) // 8 for c in frame["cids"]])
        groups = np.frombuffer(b"".join(c if alone else g for c, g, alone in zip(frame["cids"], frame["groups"], own, strict=True)), dtype=np.int64)
        order = np.lexsort((~named, cids, keys))
        keys, cids, groups, index = keys[order], cids[order], groups[order], index[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (cids[1:] != cids[:-1])
        keys, cids, groups, index = keys[first], cids[first], groups[first], index[first]
        bucket = int(frame["bucket"].iloc[0])
        if bucket >= buckets:  # it has only some classes of its keys; a join tells which lie in several groups
            return pd.DataFrame({"key": ~keys, "group": groups, "cid": cids, "is_index": index})
        number = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1]))) - 1 if len(keys) else keys
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
        across = (np.minimum.reduceat(groups, starts) != np.maximum.reduceat(groups, starts))[number] if len(keys) else first
        return pd.DataFrame({"key": keys[across] + (bucket << 39), "group": groups[across], "cid": cids[across], "is_index": index[across]})

    dealt = docs.mapInArrow(alone, _PACKED).unionByName(grouped_sets.select("cid", "tokens", "group").mapInArrow(together, _PACKED))
    return dealt.groupBy("bucket").applyInPandas(runs, "key long, group long, cid long, is_index boolean")


def _near_groups(docs: DataFrame, classes: DataFrame, grouped_sets: DataFrame, total: int, width: int, percent: int) -> DataFrame:
    """Pairs (group1, group2) of which classes have a prefix key in common and near sizes."""
    frequent = _frequent_tokens(docs, classes.count(), width)
    buckets = max(8, -(-2 * total * (100 - percent) // 100 // BUCKET_POSTINGS))
    shared = _shared_keys(docs, grouped_sets, buckets, width, percent, frequent)
    rows = shared.join(classes.select("cid", "n"), "cid").groupBy("key", "group").agg(F.max("is_index").alias("is_index"), F.min("n").alias("low"), F.max("n").alias("high"))
    rows = materialize(rows, "postings")
    # Keys of just the same groups say the same; one of them is enough.
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.bit_xor(F.xxhash64("group", "is_index", "low", "high")).alias("one"), F.sum(F.pmod(F.hash("group", "is_index", "low", "high"), F.lit(1 << 30))).alias("two")).where("groups > 1")
    once = lists.groupBy("groups", "one", "two").agg(F.min("key").alias("key")).select("key")
    rows = materialize(rows.join(once, "key"), "postings")
    side = lambda name: rows.select("key", *(F.col(c).alias(f"{c}{name}") for c in ("group", "is_index", "low", "high")))
    met = side(1).join(side(2), "key").where(f"group1 < group2 and ((is_index1 and low1 <= high2) or (is_index2 and low2 <= high1)) and high1 * 100 >= low2 * {percent} and high2 * 100 >= low1 * {percent}")
    return materialize(met.select("group1", "group2").distinct(), "near-groups")


def _links_across(docs: DataFrame, classes: DataFrame, members: DataFrame, grouped_sets: DataFrame, unions: DataFrame, total: int, width: int, percent: int) -> DataFrame:
    """Links (u, v) between classes of different groups; members has the classes (cid, group, n) of groups of several."""
    near = _near_groups(docs, classes, grouped_sets, total, width, percent)
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    of = lambda name: sizes.select(F.col("group").alias(f"group{name}"), F.col("members").alias(f"members{name}"))
    near = near.join(of(1), "group1", "left").join(of(2), "group2", "left").na.fill(1, ["members1", "members2"])
    # The group with fewer members asks, the other is asked.
    first = F.struct("members1", "group1") <= F.struct(F.col("members2").alias("members1"), F.col("group2").alias("group1"))
    either = lambda name, one, two: F.when(first, F.col(f"{name}{one}")).otherwise(F.col(f"{name}{two}"))
    near = materialize(near.select(either("group", 1, 2).alias("asks"), either("members", 1, 2).alias("asking"), either("group", 2, 1).alias("group"), either("members", 2, 1).alias("asked")), "near-groups")
    # A group of one class has the class's name and is its own union: comparing the sets is the bound.
    alone = near.where("asked = 1").select(F.col("asks").alias("u"), F.col("group").alias("v"))
    by_members = near.where("asked > 1 and asking > 1").select("asks", "group").join(members.select("cid", F.col("group").alias("asks")), "asks").select("cid", "group")
    asked = materialize(near.where("asked > 1 and asking = 1").select(F.col("asks").alias("cid"), "group").unionByName(by_members), "asked")
    sets = fetch_sets(docs, classes, _both(alone).unionByName(asked.select("cid")), width)
    links = compare(alone, sets, percent)
    if asked.isEmpty():
        return materialize(links.select("u", "v"), "links")
    overlaps = _overlaps(asked.join(sets, "cid"), unions, shared=False).join(classes.select("cid", "n"), "cid")
    opened = overlaps.where(F.col("overlap") * 100 >= F.col("n") * percent).select(F.col("cid").alias("u"), "n", "group")
    opened = opened.join(members.select(F.col("cid").alias("v"), F.col("n").alias("m"), "group"), "group").where(_size_bound("n", "m", percent))
    opened = materialize(opened.select("u", "v"), "opened")
    links = links.unionByName(compare(opened, sets.unionByName(grouped_sets.select("cid", "tokens")).dropDuplicates(["cid"]), percent))
    return materialize(links.select("u", "v"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, cid, root) for every row: connected components of Jaccard >= percent / 100.

    cid names the text's shingle set and root the component, also where ids are repeated or null (null without shingles).
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with temporaries():
        rows = materialize(profiles(docs, "doc_id", "text", width), "profiles", keep=True)
        sets = rows.where("n_shingles > 0")
        classes = materialize(sets.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes", keep=True)
        total = classes.agg(F.sum("n")).first()[0] or 0
        pairs = _named_pairs(classes, GROUP_PERCENT)
        near_sets = fetch_sets(docs, classes, _both(pairs), width)
        near = materialize(compare(pairs, near_sets, percent, GROUP_PERCENT), "near-links")
        both = near.select("u", "v", F.explode(F.when(F.col("linked"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
        roots = components(both, "part").groupBy(F.col("node").alias("cid")).agg(F.max(F.when(F.col("part") == 0, F.col("root"))).alias("group"), F.max(F.when(F.col("part") == 1, F.col("root"))).alias("core"))
        members = materialize(roots.join(classes.select("cid", "n"), "cid").select("cid", "group", F.coalesce("core", "cid").alias("core"), "n"), "groups")
        grouped_sets = materialize(near_sets.join(members, "cid").select("cid", "tokens", "group", "n"), "grouped-sets", codec="none")
        unions = _matrix(grouped_sets)
        within = materialize(_links_within(members, grouped_sets, unions, percent), "links")
        across = _links_across(docs, classes, members, grouped_sets, unions, total, width, percent)
        links = near.where("linked").select("u", "v").unionByName(within).unionByName(across)
        grouped = materialize(components(links), "components", keep=True)
    named = classes.select("cid", "rep").join(grouped.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    labels = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = named.join(labels, "root").select("cid", "component_id", "root")
    with_sets = sets.select("doc_id", "n_shingles", "cid").join(of_class, "cid").select("doc_id", "n_shingles", "component_id", "cid", "root")
    result = with_sets.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")), allowMissingColumns=True)
    return result.select(F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "n_shingles", F.expr(f"nullif(component_id, {NO_ID})").alias("component_id"), "cid", "root")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns, of which each component in `found` (of near_duplicates) keeps one: of its smallest id.

    A bitmap of the ids that go or are repeated tells the other rows, which stay without a shuffle;
    what hits it is decided by a join. Rows whose id is null or repeated are decided by their own shingle sets, so only
    rows of one component replace each other; those without shingles all stay.
    """
    with temporaries():
        unclear = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"), "unclear", keep=True)
        marked = materialize(found.where("doc_id <> component_id").select("doc_id").union(unclear).where("doc_id is not null"), "marked")
        bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(marked))
    rows = lambda hit: rows_that_may_hold(docs, id_col, bits, hit)
    named = found.where("doc_id = component_id").select("doc_id").join(unclear, "doc_id", "left_anti")
    clear = rows(True).join(named.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    kept = rows(False).unionByName(clear.select(*docs.columns))
    if unclear.isEmpty():
        return kept
    of_repeated = rows(True).join(unclear.where("doc_id is not null").select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*docs.columns)
    doubtful = of_repeated.unionByName(rows(True).where(F.col(id_col).isNull())).select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("k"))
    doubtful = materialize(doubtful, "doubtful", keep=True)
    profiled = profiles(doubtful.select("k", F.col("row")[text_col].alias("text")), "k", "text", width).select(F.col("doc_id").alias("k"), "n_shingles", "cid")
    of_class = found.where("cid is not null").groupBy("cid").agg(F.first("component_id").alias("component_id"), F.first("root").alias("root"))
    decided = doubtful.join(profiled, "k")
    first = decided.where("n_shingles > 0").join(of_class, "cid").where(F.col("row")[id_col].cast("long").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return kept.unionByName(first.select("row.*")).unionByName(decided.where("n_shingles = 0").select("row.*"))
