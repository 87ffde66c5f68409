"""Jaccard similarity join of word-shingle sets, by adaptive prefixes with several matches.

All sets are sorted by one order, rare shingles first. If two sets of x and y shingles are similar enough, they share
at least o = max(ceil(t x), ceil(t y)) of them, so their first x - o + k and y - o + k shingles share at least k, for any k.
Each set picks its own k: a longer prefix costs more list entries but asks for more matches, so fewer candidates
are verified. Once two sets meet, both sizes are known, and o is the overlap that this pair needs: they are candidates
if they share k = min(k of both) shingles among the first x - o + k and y - o + k.

Links serve to group documents, so they need not all be listed. Equal sets count once. Then each set is compared with
the two hubs that it shares the most prefix shingles with (a hub: the set of a list whose own shingles are the most
common). Only candidates that these links leave in different groups are verified one by one; those inside one
group are linked already.

A shingle that many sets have in their prefix has a long list, whose pairs are never listed. Its members are described
anew, by how each differs from a centre c (the shingles that most members have). With d(a) the number of shingles in
just one of a and c, and m(a, b) the number that the differences of a and b have in common, a and b differ in
d(a) + d(b) - 2 m(a, b) shingles, and link if that is at most (1 - t) / (1 + t) of their summed sizes x + y. So with
s(a) = d(a) - x (1 - t) / (1 + t), they link if m(a, b) >= (s(a) + s(b)) / 2. If s(a) + s(b) <= 0 that needs nothing in
common: all such links are kept whole by those with the member of the least s. Every other pair must share differences, and
these are joined by prefixes just as the sets themselves are (which are their own differences from an empty centre).
A shingle of a difference belongs to at most half of the members, so lists that are still long are described anew
from a nearer centre, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import dropped, give_back, join_hot, only, settled, small_batches, written

#: Counters of the frequency sketch: a fixed size, whatever the corpus.
SKETCH_BITS = 22
_BLOCK_BITS = 16
#: The most matches that a prefix may ask for.
MATCHES = 8
#: A list with more sets than this is described anew, by differences from a centre.
LONG = 128
#: Members of a group that one task looks at together when it seeks the centre.
_SLICE = 5000
#: Pairs whose ends may be broadcast, if the texts are at least so many times as many.
_FEW, _FEWER = 1 << 18, 16

_SETS = "doc_id long, n long, sig binary, text binary, block int, counts binary"
_PREFIX = "token long, sid long, n long, pos int, common boolean"
_ENTRIES = ["gid", "token", "sid", "n", "d", "s", "need", "pos"]


#: Bytes of texts whose words are hashed together. Longer words than _LONG_WORD bytes are hashed one by one.
_TOGETHER, _LONG_WORD = 1 << 16, 64
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: By number of bytes: the low ones of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data start, and a 64-bit hash of each; words are parted by ASCII white space."""
    raw = np.frombuffer(b" %b        " % data, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    longest = min(int(lengths.max(initial=0)), _LONG_WORD)
    for at in range(0, longest, 8):
        own = np.flatnonzero(lengths > at)
        x = eights[starts[own] + at] & _LOW[np.minimum(lengths[own] - at, 8)]
        x = (h[own] ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        h[own] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(lengths > _LONG_WORD):
        word = raw[starts[i] : starts[i] + lengths[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return starts - 1, h


def _sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    starts, w = _word_hashes(b" ".join(texts))
    h = w[: max(0, len(w) - size + 1)].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(h) + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, ends).tolist()
    for text, i, j in zip(texts, [0, *bounds[:-1]], bounds, strict=True):
        if i == j:
            yield np.zeros(0, np.uint64)
        elif j - i < size:
            whole = hashlib.blake2b(b"\0" + b" ".join(text.split()), digest_size=8).digest()
            yield np.frombuffer(whole, np.uint64).copy()
        else:
            own = np.sort(h[i : j - size + 1])
            new = own[1:] != own[:-1]
            yield own if new.all() else np.concatenate([own[:1], own[1:][new]])


def shingled(texts: Iterable[bytes], size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text with the sorted 64-bit hashes of its distinct shingles of `size` words (parted by ASCII white space); with fewer words, of all of them."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= _TOGETHER:
            yield from zip(held, _sets_of(held, size), strict=True)
            held, n = [], 0
    if held:
        yield from zip(held, _sets_of(held, size), strict=True)


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # bytes.lower() is for A-Z only


def _sets(size: int):
    """A row for each document (its text only where the task hasn't yet seen the set), then the task's share of the sketch."""

    def run(batches):
        only("shingles")
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        shift, pack = np.uint64(64 - SKETCH_BITS), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part, rows = b.slice(i, 1000), []
                tokens = []
                texts = map(_lowered, part["text"].to_pylist())
                for doc_id, (text, own) in zip(part["doc_id"].to_pylist(), shingled(texts, size), strict=True):
                    sig = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    first = sig is not None and sig not in seen
                    if first:
                        seen.add(sig)
                        tokens.append(own)
                    rows.append((doc_id, len(own), sig, pack.compress(text) if first else None, None, None))
                if tokens:
                    np.add.at(sketch, (np.concatenate(tokens) >> shift).astype(np.int64), 1)
                yield _set_batch(rows)
        for k in range(1 << (SKETCH_BITS - _BLOCK_BITS)):
            block = sketch[k << _BLOCK_BITS : (k + 1) << _BLOCK_BITS]
            if block.any():
                yield _set_batch([(None, None, None, None, k, pack.compress(block.astype("<u4").tobytes()))])
        give_back()

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["doc_id", "n", "sig", "text", "block", "counts"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total, unpack = np.zeros(1 << _BLOCK_BITS, np.int64), zstandard.ZstdDecompressor()
    for c in pdf["counts"]:
        total += np.frombuffer(unpack.decompress(c), "<u4")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """For each counter 0 where its shingles are about as common as most, then one more for each doubling of what is beyond that.

    A counter that many rare shingles fall on comes to the mean, give or take its root: three times that tells apart.
    """
    counts, unpack = np.zeros(1 << SKETCH_BITS, np.int64), zstandard.ZstdDecompressor()
    merged = sets.where(F.col("block").isNotNull()).select("block", "counts").groupBy("block").applyInPandas(_added, "block int, counts binary")
    for r in merged.toLocalIterator():
        counts[r["block"] << _BLOCK_BITS : (r["block"] + 1) << _BLOCK_BITS] = np.frombuffer(unpack.decompress(r["counts"]), np.int64)
    beyond = (counts - counts.mean()) / (1 + 3 * counts.mean() ** 0.5)
    return np.where(beyond > 1, np.floor(np.log2(np.maximum(beyond, 1))) + 1, 0).astype(np.uint8)


def rare_first(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """tokens in the order that all sets share: by class, then by the hash itself."""
    key = (classes[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens & np.uint64((1 << 56) - 1))
    return tokens[np.lexsort((tokens, key)) if len(tokens) < 32 else np.argsort(key, kind="stable")]


def _prefixes(size: int, num: int, den: int, shared):
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches):
        only("shingles")
        classes, unpack = shared.value, zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, out = b.slice(i, 500), []
                texts = map(unpack.decompress, part["text"].to_pylist())
                for sid, (_, own) in zip(part["sid"].to_pylist(), shingled(texts, size), strict=True):
                    need = -(-num * len(own) // den)
                    p = min(len(own), len(own) - need + MATCHES)
                    out.append((rare_first(own, classes)[:p].view(np.int64), sid, len(own)))
                if out:
                    lengths = np.array([len(t) for t, _, _ in out])
                    tokens = np.concatenate([t for t, _, _ in out])
                    pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    columns = [tokens, np.repeat(np.array([s for _, s, _ in out], np.int64), lengths), np.repeat(np.array([n for _, _, n in out], np.int64), lengths), pos.astype(np.int32)]
                    common = classes[(tokens.view(np.uint64) >> shift).astype(np.int64)] > 0
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, common)], ["token", "sid", "n", "pos", "common"])
        give_back()

    return run


def _verifier(size: int, num: int, den: int):
    def run(batches):
        unpack, cache = zstandard.ZstdDecompressor(), {}
        for b in batches:
            linked = []
            for i in range(0, b.num_rows, 50):
                one, two, text_a, text_b = (b[c].slice(i, 50).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                texts = dict(zip(one + two, text_a + text_b, strict=True))
                if len(cache) > 100:
                    cache = {sid: cache[sid] for sid in texts if sid in cache}
                new = [sid for sid in texts if sid not in cache]
                found = shingled((unpack.decompress(texts[sid]) for sid in new), size)
                cache.update((sid, own) for sid, (_, own) in zip(new, found, strict=True))
                for sa, sb in zip(one, two, strict=True):
                    x, y = cache[sa], cache[sb]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        give_back()

    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """pairs (a, b) with linked: whether den * intersection >= num * union. For few pairs only their own texts are shuffled."""
    pairs = written(pairs.select("a", "b"), "pairs")
    n = pairs.count()
    if n <= _FEW and n * _FEWER <= texts.count():
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        texts = texts.join(F.broadcast(ends), "sid", "left_semi")
    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_verifier(size, num, den), "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """sid, root: the group of each end of the edges (a, b), as a table."""
    return settled(edges.sparkSession, "components", lambda: _components(edges))


def _components(edges: DataFrame) -> DataFrame:
    """By contraction. In each round every node points to the least of its neighbours and itself, pointers are followed to their end,
    and edges are drawn between the ends; nodes of one edge fall together, so rounds go with the logarithm.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("b").alias("sid"), F.col("a").alias("near")).union(edges.select("a", "a"))
        jump = written(ends.groupBy("sid").agg(F.min("near").alias("root")), "pointers")
        while True:
            nxt = jump.select(F.col("sid").alias("root"), F.col("root").alias("next"))
            moved = written(jump.join(nxt, "root").select("sid", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
            jump = moved.select("sid", "root")
            if moved.where("moved").isEmpty():
                break
        a = jump.select(F.col("sid").alias("a"), F.col("root").alias("ra"))
        b = jump.select(F.col("sid").alias("b"), F.col("root").alias("rb"))
        drawn = edges.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = written(drawn.where("a < b").distinct(), "edges")
        if labels is None:
            labels = jump
        else:
            step = jump.select(F.col("sid").alias("root"), F.col("root").alias("next"))
            labels = written(labels.join(step, "root", "left").select("sid", F.coalesce("next", "root").alias("root")), "labels")
    if labels is None:
        return edges.select(F.col("a").alias("sid"), F.col("b").alias("root"))
    return labels


def _sid() -> Column:
    """A set's number: eight bytes of its 16-byte signature."""
    return F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")


def _numbered(sets: DataFrame) -> DataFrame:
    """sets with sid. Should two signatures share it, theirs comes from other bytes of the signature."""
    rows = sets.where(F.col("sig").isNotNull()).withColumn("sid", _sid())
    twice = rows.groupBy("sid").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x != y").select("sid")
    clash = [r["sid"] for r in twice.limit(10_001).collect()]
    if len(clash) > 10_000:
        raise ValueError("too many sets for 64-bit numbers")
    other = F.conv(F.hex(F.substring("sig", 9, 8)), 16, -10).cast("long")
    return rows.withColumn("sid", F.when(F.col("sid").isin(clash), other).otherwise(F.col("sid"))) if clash else rows


def _first_entries(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of the sets themselves, each once, in the lists of two sets or more, with df (the sets in the list).

    The counters of class 0 stay near the mean of all counters, a four-millionth of all shingles, so the lists of their shingles
    are even enough to be counted where they lie. The others are counted before they are shuffled, and joined with their counts however hot they are.
    """
    by_token = Window.partitionBy("token")
    rare = prefixes.where(~F.col("common")).withColumn("df", F.count(F.lit(1)).over(by_token)).where("df > 1").drop("df")
    # a set that several tasks came across has its prefix there as often
    rare = rare.dropDuplicates(["token", "sid"]).withColumn("df", F.count(F.lit(1)).over(by_token)).where("df > 1")
    common = written(prefixes.where("common").dropDuplicates(["token", "sid"]), "common-entries")
    counts = written(common.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common-counts")
    every = rare.unionByName(join_hot(common, counts, ["token"], "df", common.count()))
    need = F.ceil(F.col("n") * num / den).cast("long")
    return every.select(
        F.lit(0).cast("long").alias("gid"), "token", "sid", "n", F.col("n").alias("d"), (F.col("n") * 2 * num).alias("s"), need.alias("need"), "pos", "df"
    )


def _first_lists(texts: DataFrame, size: int, num: int, den: int, classes) -> DataFrame:
    prefixes = written(texts.mapInArrow(_prefixes(size, num, den, classes), _PREFIX), "prefixes")
    entries = written(_first_entries(prefixes, num, den), "entries")
    dropped(prefixes)
    return _chosen(entries)


def _chosen(entries: DataFrame) -> DataFrame:
    """The entries within the prefix of each set's own k matches, with k."""
    reach = [F.col("d") - F.col("need") + k for k in range(1, MATCHES + 1)]
    sums = [F.sum(F.when(F.col("pos") < reach[k], F.col("df")).otherwise(0)).alias(f"df{k}") for k in range(MATCHES)]
    one = [F.sum(F.when(F.col("pos") < reach[k], 1).otherwise(0)).alias(f"own{k}") for k in range(MATCHES)]
    per_set = entries.groupBy("gid", "sid").agg(F.first("n").alias("n"), F.first("need").alias("need"), *sums, *one)
    # an entry costs 1, a verification about a twentieth of a set's size; k matches leave a k-th of the entries as candidates at most
    cost = [F.col(f"df{k}") + (F.col(f"df{k}") - F.col(f"own{k}")) / (k + 1) * F.col("n") / 20 for k in range(MATCHES)]
    allowed = [F.when(F.col("need") > k, cost[k]) for k in range(MATCHES)]
    least = F.least(*allowed)
    choice = F.coalesce(*[F.when(allowed[k] == least, F.lit(k + 1)) for k in range(MATCHES)], F.lit(1))
    chosen = per_set.select("gid", "sid", choice.alias("k"))
    kept = entries.join(chosen, ["gid", "sid"]).where(F.col("pos") < F.col("d") - F.col("need") + F.col("k"))
    return kept.select(*_ENTRIES, "df", "k")


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """The smaller set is large enough for the larger one."""
    return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)


def _with_hub(lists: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the hub of each list: the set whose entries have the longest lists."""
    weighed = lists.withColumn("weight", F.sum("df").over(Window.partitionBy("gid", "sid")))
    return weighed.groupBy(*keys).agg(F.max(F.struct("weight", "sid", "n")).alias("hub"), F.count(F.lit(1)).alias("n_rows"))


def _hub_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Each set with up to two hubs of its lists, those with the most matches."""
    hubs = written(_with_hub(lists, ["token"]), "hubs")
    votes = join_hot(lists, hubs, ["token"], "n_rows", lists.count()).select("sid", "n", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("m")).where("sid != hub")
    votes = votes.where(_fits("n", "m", num, den)).groupBy("sid", "hub").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("sid").orderBy(F.desc("votes"), "hub")
    picked = votes.withColumn("rank", F.row_number().over(best)).where("rank <= 2")
    return picked.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with root, of lists whose sets aren't all in one group; df is counted anew."""
    grouped = written(lists.drop("df").join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "grouped-entries")
    mixed = grouped.groupBy("gid", "token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("df")).where("x != y")
    return join_hot(grouped, mixed.select("gid", "token", "df"), ["gid", "token"], "df", grouped.count())


def _cross_pairs(entries: DataFrame, done: list[DataFrame], num: int, den: int) -> DataFrame:
    """Candidates in different groups, from lists of a bounded length, that haven't been verified yet."""
    columns = ("sid", "n", "d", "s", "pos", "k", "root")
    one = entries.select("gid", "token", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = entries.select("gid", "token", *[F.col(c).alias(f"{c}_b") for c in columns])
    k = F.least("k_a", "k_b")
    overlap = F.ceil((F.col("s_a") + F.col("s_b")) / (2 * (num + den))).cast("long")
    early = (F.col("pos_a") < F.col("d_a") - overlap + k) & (F.col("pos_b") < F.col("d_b") - overlap + k)
    needed = (F.col("sid_a") < F.col("sid_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("s_a") + F.col("s_b") > 0)
    met = one.join(two, ["gid", "token"]).where(needed & _fits("n_a", "n_b", num, den) & early)
    met = met.select("gid", F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), k.alias("k"), overlap.alias("overlap"))
    enough = met.groupBy("gid", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("k").alias("k"), F.first("overlap").alias("o")).where("shared >= least(k, o)")
    new = enough.select("a", "b").distinct()
    for pairs in done:
        new = new.join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return new


def _members(entries: DataFrame) -> DataFrame:
    """gid, sid, n, n_rows, part: the sets of each group of long lists, in parts of a bounded size.

    Lists of the sets themselves whose hub is the same are one group; later on each list is one, so groups halve at least.
    """
    total = entries.count()
    lists = written(_with_hub(entries, ["gid", "token"]), "long-lists")
    of_list = F.when(F.col("gid") == 0, F.xxhash64("hub.sid")).otherwise(F.xxhash64("gid", "token"))
    joined = join_hot(entries.select("gid", "token", "sid", "n"), lists.select("gid", "token", of_list.alias("group"), "n_rows"), ["gid", "token"], "n_rows", total)
    members = written(joined.select(F.col("group").alias("gid"), "sid", "n").distinct(), "members")
    sizes = written(members.groupBy("gid").agg(F.count(F.lit(1)).alias("n_rows")), "member-counts")
    part = F.pmod(F.xxhash64("sid"), F.ceil(F.col("n_rows") / _SLICE)).cast("long")
    return written(join_hot(members, sizes, ["gid"], "n_rows", members.count()).withColumn("part", part), "members")


def _tally(size: int):
    """gid, token, n: how many of a part's members have a shingle, of those that a quarter of them have."""

    def run(batches):
        unpack, gid, sets = zstandard.ZstdDecompressor(), None, []

        def counted():
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            keep = 4 * n >= len(sets)
            columns = [np.full(int(keep.sum()), gid[0], np.int64), tokens[keep].view(np.int64), n[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gid", "token", "n"])

        for b in batches:
            texts = map(unpack.decompress, b["text"].to_pylist())
            for g, part, (_, own) in zip(b["gid"].to_pylist(), b["part"].to_pylist(), shingled(texts, size), strict=True):
                if gid != (g, part) and sets:
                    yield counted()
                    sets = []
                gid = g, part
                sets.append(own)
        if sets:
            yield counted()
        give_back()

    return run


def _differences(size: int, num: int, den: int, shared):
    """gid, sid, n, d, s, tokens: how each member differs from its group's centre, in an order that the group shares.

    First what the set has beyond the centre, rare shingles first; then what it lacks, first what the fewest lack.
    """

    def run(batches):
        classes, unpack = shared.value, zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), []
                texts = map(unpack.decompress, part["text"].to_pylist())
                for gid, sid, centre, (_, own) in zip(*(part[c].to_pylist() for c in ("gid", "sid", "centre")), shingled(texts, size), strict=True):
                    middle = np.array(centre or [], np.int64).view(np.uint64)
                    beyond = rare_first(np.setdiff1d(own, middle, assume_unique=True), classes)
                    lacking = middle[~np.isin(middle, own, assume_unique=True)]
                    d = len(beyond) + len(lacking)
                    rows.append((gid, sid, len(own), d, (num + den) * d - (den - num) * len(own), np.concatenate([beyond, lacking]).tobytes()))
                if rows:
                    types = (*[pa.int64()] * 5, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["gid", "sid", "n", "d", "s", "tokens"])
        give_back()

    return run


def _difference_prefixes(batches):
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part, out = b.slice(i, 500), []
            for row in zip(*(part[c].to_pylist() for c in ("gid", "sid", "n", "d", "s", "need", "tokens")), strict=True):
                tokens = np.frombuffer(row[-1], np.int64)[: max(0, row[3] - row[5] + MATCHES)]
                out.append((tokens, *row[:-1]))
            lengths = np.array([len(o[0]) for o in out])
            if lengths.sum():
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                gid, sid, n, d, s, need = (np.repeat(np.array([o[k] for o in out], np.int64), lengths) for k in range(1, 7))
                columns = [gid, np.concatenate([o[0] for o in out]), sid, n, d, s, need, pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _ENTRIES)


def _described_anew(entries: DataFrame, texts: DataFrame, classes, size: int, num: int, den: int) -> DataFrame:
    """The lists of the members' differences from the centre, and in columns a and b links with each group's nearest member."""
    members = _members(entries)
    held = written(members.join(texts, "sid"), "member-texts")
    parts = held.select("gid", "part", "text").repartition("gid", "part").sortWithinPartitions("gid", "part")
    tally = parts.mapInArrow(_tally(size), "gid long, token long, n long").groupBy("gid", "token").agg(F.sum("n").alias("n"))
    sizes = members.groupBy("gid").agg(F.first("n_rows").alias("n_rows"))
    most = tally.join(sizes, "gid").where(F.col("n") * 2 > F.col("n_rows"))
    # what most members have is at most twice as much as a member has on average
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))), lambda x: x["token"])
    centres = sizes.join(most.groupBy("gid").agg(ordered.alias("centre")), "gid", "left")
    dealt = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_rows") / _SLICE) - 1))).select("gid", "part", "centre")
    described = held.join(dealt, ["gid", "part"]).mapInArrow(_differences(size, num, den, classes), "gid long, sid long, n long, d long, s long, tokens binary")
    described = written(described, "differences")
    near = described.groupBy("gid").agg(F.min(F.struct("s", "sid")).alias("near"), F.count(F.lit(1)).alias("n_rows"))
    found = join_hot(described, written(near, "nearest"), ["gid"], "n_rows", described.count())
    at_centre = F.col("s") + F.col("near.s") <= 0
    star = found.where(at_centre & (F.col("sid") != F.col("near.sid"))).select(F.least("sid", "near.sid").alias("a"), F.greatest("sid", "near.sid").alias("b")).distinct()
    # those at the centre are linked already, so they only need the others, whose s is larger than -near.s
    partner = F.when(at_centre, 1 - F.col("near.s")).otherwise(F.col("near.s"))
    need = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("s") + partner) / (2 * (num + den))).cast("long"))
    types = ", ".join(f"{c} {'int' if c == 'pos' else 'long'}" for c in _ENTRIES)
    spread = found.withColumn("need", need).select("gid", "sid", "n", "d", "s", "need", "tokens").mapInArrow(_difference_prefixes, types)
    spread = written(spread, "difference-entries")
    counts = written(spread.groupBy("gid", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "difference-counts")
    lists = _chosen(written(join_hot(spread, counts, ["gid", "token"], "df", spread.count()), "difference-lists"))
    return lists.unionByName(star, allowMissingColumns=True)


def similarity_groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    Two documents link if the Jaccard similarity of their shingle sets is num/den or more; component_id is the
    least doc_id that links lead to (the own one without links). Shingles are `size` words in a row, lower-cased
    (A-Z only), words being parted by ASCII white space; fewer words are one shingle. Documents without words,
    null texts too, have an empty set and link with nothing. Repeated rows get the same component; a null
    doc_id never names a group that has another id. Other columns are ignored; an empty table gives no rows.
    Pairs are listed only in lists of up to `long` sets; longer ones are described anew, without loss of a link.
    """
    return settled(docs.sparkSession, "similarity-groups", lambda: _similarity_groups(docs, size, num, den, long))


def _similarity_groups(docs: DataFrame, size: int, num: int, den: int, long: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = written(rows.mapInArrow(_sets(size), _SETS), "shingle-sets")
    sets = _numbered(every)
    classes = spark.sparkContext.broadcast(frequency_classes(every))
    texts = sets.where(F.col("text").isNotNull()).select("sid", "text")
    lists = settled(spark, "lists", lambda: _first_lists(texts, size, num, den, classes))
    # the texts that may have a partner, each once
    some = settled(spark, "candidate-texts", lambda: texts.join(lists.select("sid").distinct(), "sid").dropDuplicates(["sid"]))
    # of the documents only their numbers are needed from here on
    numbers = sets.select("doc_id", "n", "sid").unionByName(every.where(F.col("sig").isNull() & F.col("n").isNotNull()).select("doc_id", "n"), allowMissingColumns=True)
    numbers = written(numbers, "set-numbers")
    dropped(every)
    checked = [settled(spark, "hub-links", lambda: verify(_hub_pairs(lists, num, den), some, size, num, den))]
    links = checked[0].where("linked").select("a", "b")
    labels = components(links)
    while True:
        entries = settled(spark, "cross-entries", lambda lists=lists, labels=labels: _mixed(lists, labels))
        found = verify(_cross_pairs(entries.where(F.col("df") <= long), checked, num, den), some, size, num, den)
        checked.append(written(found, "cross-links"))
        new, far = checked[-1].where("linked").select("a", "b"), entries.where(F.col("df") > long)
        more = not far.isEmpty()
        if more:
            anew = settled(spark, "described", lambda far=far: _described_anew(far, some, classes, size, num, den))
            lists = anew.where("a IS NULL").drop("a", "b")
            new = new.unionByName(anew.where("a IS NOT NULL").select("a", "b"))
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)
        if not more:
            break
    own = numbers.where(F.col("sid").isNotNull()).join(labels, "sid", "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    own = written(own, "roots")
    per_root = own.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    return _with_least(own, per_root, numbers)


def _with_least(own: DataFrame, per_root: DataFrame, numbers: DataFrame) -> DataFrame:
    grouped = written(per_root.where("n_rows > 1"), "groups")
    single = own.join(grouped.select("root"), "root", "left_anti").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    several = join_hot(own, grouped, ["root"], "n_rows", own.count()).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    empty = numbers.where(F.col("sid").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return single.unionByName(several).unionByName(empty)
