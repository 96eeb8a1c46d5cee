"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of word 5-grams. Tokens have one order for all documents: rare ones by their hash, then frequent ones by
frequency. If two sets are similar enough, their first quarters in this order share a token: which documents may visit
which is told by the tokens of the first quarters, and similar documents, those with one smallest neighbour, make a group.
The matrix holds each group's token union, and behind each token the members that have it; it is stored. A visitor's set is
held against the union first, which bounds what it can share with any member; only a group whose bound reaches the threshold
is opened, and its members are counted exactly. All links but those of equal sets come out of the matrix.

Two rounds: first the neighbours by rare tokens and, for each frequent token, its smallest document; then what frequent
tokens alone can link and is still apart. Two sets that share no rare token can be linked only by their frequent ones, so of
all sets with the same frequent tokens the smallest stands for the others there. Only links that could join two components
matter, so a component already joined isn't opened again.

Places bound what two sets can share. If their first common token has the places p and q in sets of n and m tokens, they share
at most min(n - p, m - q) + 1; who can't reach the threshold so doesn't visit. Pages made of common passages in ever new orders
share many frequent tokens, but only late ones, so they stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, GRAM, LOWER, by_bucket, flat, might_hold, mix, parts_for, prefix_hash, range_hash, slices, small_batches, stored, unpack, unused, word_ranges
from .components import components, joined_further

#: Words of a shingle; two sets are linked from 75 % on.
WIDTH, NUM, DEN = 5, 3, 4
#: A token in more documents is frequent. Small groups have at most so many members.
FEW = 8
#: Frequencies are kept in one byte for each of 2^24 token hashes (16 MB, broadcast); tokens that share a byte share the higher level.
LEVEL_BITS, BLOCK_BITS = 24, 18
#: Frequent tokens are dealt out to a task for each so many documents. A group has about so many members and tokens, and so many visitors come to one copy of it.
SALT_ROWS, CHUNK, TOKENS, VISITORS, HOT = 4096, 256, 1 << 18, 1024, 500
#: Id of null ids.
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit tokens of each text; fewer than five words are one token, no words none."""
    start, end, row = word_ranges(data, offs, BLANK)
    h = range_hash(prefix_hash(LOWER[data]), start, end)
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.r_[0, np.cumsum(count)]
    grams = np.zeros(0, np.uint64)
    if len(h) >= WIDTH:
        grams = h[: len(h) - WIDTH + 1] * GRAM[0]
        for k in range(1, WIDTH):
            grams = grams + h[k : len(h) - WIDTH + 1 + k] * GRAM[k]
        grams = mix(grams)
    for i, c in enumerate(count):
        f = first[i]
        if c >= WIDTH:
            yield np.unique(grams[f : f + c - WIDTH + 1])
        elif c:
            yield mix(np.array([(h[f : f + c] * GRAM[:c]).sum() + np.uint64(c)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def all_sets(column) -> Iterator[np.ndarray]:
    data, offs = flat(column)
    for i, j in slices(offs):
        yield from shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def bucket_of(t: np.ndarray, n: int) -> np.ndarray:
    return ((t >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def frequency_levels(texts: DataFrame, n: int) -> np.ndarray:
    """Level by token hash: 0, or 1 + log2 of how often the token's documents exceed FEW. Counts all tokens over all documents."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            t = np.concatenate(held)
            rows = list(by_bucket(bucket_of(t, n), t.astype(np.uint32)))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([c[0] for _, c in rows], pa.binary())})

        for batch in batches:
            for s in all_sets(batch["t"]):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def frequent(t: pa.Table) -> pa.Table:
        token, c = np.unique(unpack(t["data"], np.uint32), return_counts=True)
        token, c = token[c > FEW] & np.uint32((1 << LEVEL_BITS) - 1), c[c > FEW]
        level = (1 + np.log2(c / FEW)).astype(np.uint8)
        rows = list(by_bucket((token >> np.uint32(BLOCK_BITS)).astype(np.int32), token & np.uint32((1 << BLOCK_BITS) - 1), level))
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "token": pa.array([c[0] for _, c in rows], pa.binary()), "level": pa.array([c[1] for _, c in rows], pa.binary())})

    def filled(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << BLOCK_BITS, np.uint8)
        np.maximum.at(out, unpack(t["token"], np.uint32), unpack(t["level"], np.uint8))
        return pa.table({"block": t["block"][:1], "data": pa.array([out.tobytes()], pa.binary())})

    tokens = texts.select("t").mapInArrow(packed, "bucket int, data binary").groupBy("bucket").applyInArrow(frequent, "block int, token binary, level binary")
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in tokens.groupBy("block").applyInArrow(filled, "block int, data binary").toLocalIterator():
        levels[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(r.data, np.uint8)
    return levels


ROWS = "kind int, a bigint, b bigint, c bigint, x bigint, y bigint, u bigint, v bigint"
#: Kinds of rows: a document (size, frequent tokens and their sum, signature), a pair by a rare token, a pair with the smallest document of a frequent token, a document of a frequent token (and its first place), the smallest of a part.
DOC, PAIR, STAR, MEMBER, LEADER = range(5)
#: Beside a set's size (31 bits): two flags, and how many tokens the set has beyond the rare ones of its first quarter.
LONGEST, RARE, SALTED, TAIL = (1 << 31) - 1, 1 << 31, 1 << 32, 33
DOC_COLUMNS, MASK = 7, (1 << 64) - 1


def rows_of(kind: int, *columns: np.ndarray) -> pa.Table:
    n = len(columns[0])
    cols = [np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in columns] + [np.zeros(n, np.int64)] * (7 - len(columns))
    return pa.table([pa.array(np.full(n, kind, np.int32)), *(pa.array(c) for c in cols)], names=["kind", "a", "b", "c", "x", "y", "u", "v"])


def token_groups(texts: DataFrame, levels, n: int) -> DataFrame:
    """The rows above: from each document's first quarter, the groups of documents by token."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        held, docs, size = [], [], 0

        def out():
            t, i, p, w, b = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, d) for d in (np.uint64, np.int64, np.uint32, np.int64, np.int32)]
            d = np.array(docs, np.uint64).reshape(-1, DOC_COLUMNS)
            rows = [(0, *r) for r in by_bucket(b, t, i, p, w)] + [(1, *r) for r in by_bucket((mix(d[:, 0]) % np.uint64(n)).astype(np.int32), d)]
            cols = [[c[k] if k < len(c) else None for _, _, c in rows] for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "kind", "t", "i", "p", "w"])

        for batch in batches:
            for doc, name, s in zip(batch["id"].to_numpy(), batch["doc"].to_numpy(), all_sets(batch["t"]), strict=True):
                sig = (int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()), int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum()))
                size_, lev = len(s), level[s & np.uint64((1 << LEVEL_BITS) - 1)]
                m = size_ - (NUM * size_ + DEN - 1) // DEN + 1
                hot = s[lev > 0]
                if size_ - len(hot) >= m or sig in seen:  # frequent tokens alone can't link it; or an equal set of this task does it
                    hot = hot[:0]
                docs.append((int(doc) & MASK, int(name) & MASK, size_, len(hot), int(mix(hot ^ np.uint64(0x2545F4914F6CDD1D)).sum()), *sig))
                if size_ and sig not in seen:  # of equal sets in a task, one is enough
                    seen.add(sig)
                    first = np.argsort(lev, kind="stable")[:m]
                    s, lev = s[first], lev[first]
                    tail = size_ - int((lev == 0).sum())
                    parts = np.maximum(1, (FEW << np.minimum(lev.astype(np.int64), 40)) // SALT_ROWS)
                    salted = (lev > 0) & (parts > 1)
                    b = ((bucket_of(s, n) + np.where(salted, (int(doc) & 0xFFFFFFFF) % parts, 0)) % n).astype(np.int32)
                    w = size_ + np.where(lev == 0, RARE, 0) + np.where(salted, SALTED, 0) + (tail << TAIL)
                    held.append((s, np.full(len(s), doc, np.int64), np.arange(1, len(s) + 1, dtype=np.uint32), w, b))
                    size += len(s)
                if size > 500_000 or len(docs) > 100_000:
                    yield out()
                    held, docs, size = [], [], 0
        if docs:
            yield out()

    def grouped(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        d = unpack(t.filter(pa.array(kind == 1))["t"], np.uint64).reshape(-1, DOC_COLUMNS)
        t = t.filter(pa.array(kind == 0))
        out = [rows_of(DOC, *d.T)]
        token, doc, place, w = unpack(t["t"], np.uint64), unpack(t["i"], np.int64), unpack(t["p"], np.uint32).astype(np.int64), unpack(t["w"], np.int64)
        order = np.lexsort((doc, token))
        token, doc, place, w = token[order], doc[order], place[order], w[order]
        cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.r_[cut, len(token)])
        size = w & ~(RARE | SALTED)
        small = (w[cut] & RARE > 0) & (length <= FEW) if len(cut) else np.zeros(0, bool)
        pairs = []
        for k in range(2, FEW + 1):
            at = cut[small & (length == k)]
            for i in range(k) if len(at) else ():
                for j in range(i + 1, k):
                    pairs.append((at + i, at + j))
        if pairs:
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            apart = doc[i] != doc[j]
            i, j = i[apart], j[apart]
            order = np.lexsort((doc[j], doc[i]))
            i, j = i[order], j[order]
            if len(i):
                new = np.flatnonzero(np.r_[True, (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1])])
                n_same = np.diff(np.r_[new, len(i)])
                out.append(rows_of(PAIR, doc[i][new], doc[j][new], n_same, np.maximum.reduceat(place[i], new), np.maximum.reduceat(place[j], new), size[i][new], size[j][new]))
        large = ~small & ((length > 1) | (w[cut] & SALTED > 0) if len(cut) else small)
        run = np.repeat(np.arange(len(cut)), length)
        member = np.flatnonzero(large[run]) if len(cut) else np.zeros(0, np.int64)
        if len(member):
            lead = cut[run[member]]
            pair = doc[lead] != doc[member]
            i, j = lead[pair], member[pair]
            left = np.minimum((size[i] & LONGEST) - place[i], (size[j] & LONGEST) - place[j]) + 1
            fits = (NUM + DEN) * left >= NUM * ((size[i] & LONGEST) + (size[j] & LONGEST))  # if this is their first common token
            i, j = i[fits], j[fits]
            both = np.unique(np.c_[doc[i], doc[j], size[i], size[j]], axis=0)
            z = np.zeros(len(both), np.int64)
            out.append(rows_of(STAR, both[:, 0], both[:, 1], z, z, z, both[:, 2], both[:, 3]))
            # A group's name: of a frequent token that is dealt out, the token; else its members, so that equal groups are one.
            salted = w[cut] & SALTED > 0
            sums = np.add.reduceat(mix(doc.view(np.uint64)), cut)
            name = np.where(salted, token[cut], mix(sums + length.astype(np.uint64)))
            wide = large & ((length > 2) | salted)
            once = np.zeros(len(cut), bool)
            _, one, back = np.unique(name[wide], return_index=True, return_inverse=True)
            one = np.flatnonzero(wide)[one]
            once[one] = True
            # The first place among the tokens of one name, whose documents are the same in the same order.
            every = np.flatnonzero(wide[run])
            least = place.copy()
            np.minimum.at(least, np.repeat(cut[one][back], length[wide]) + every - cut[run[every]], place[every])
            m = np.flatnonzero(once[run])
            out.append(rows_of(MEMBER, name[run[m]], doc[m], least[m]))
            out.append(rows_of(LEADER, token[cut[large & salted]], doc[cut[large & salted]]))
        return pa.concat_tables(out)

    return texts.mapInArrow(packed, "bucket int, kind int, t binary, i binary, p binary, w binary").groupBy("bucket").applyInArrow(grouped, ROWS)


def parts_of(n: str, tokens: str):
    return F.ceil(F.greatest(F.col(n) / CHUNK, F.col(tokens) / TOKENS)).cast("int")


def matrix(homes: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, id, component`` of the members and their texts -> a row for each group: its token union, and which members have each token.

    ``tokens``: sorted and distinct; ``ends``: where the owners of each token end; ``owners``: places in ``ids``, ``components`` and ``sizes``.
    """

    def united(t: pa.Table) -> pa.Table:
        sets = list(all_sets(t["t"]))
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sets])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        last = np.flatnonzero(np.r_[token[1:] != token[:-1], True]) if len(token) else np.zeros(0, np.int64)
        cells = {"ids": t["id"].to_numpy(), "components": t["component"].to_numpy(), "sizes": np.array([len(x) for x in sets], np.int64), "tokens": token[last], "ends": last + 1, "owners": owner}
        return pa.table({"key": t["key"][:1]} | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in cells.items()})

    rows = homes.select("key", "id", "component").hint("merge").join(texts.select("id", "t"), "id")
    return rows.select("key", "id", "component", "t").groupBy("key").applyInArrow(united, "key bigint, ids binary, components binary, sizes binary, tokens binary, ends binary, owners binary")


def dealt(groups: DataFrame, visits: DataFrame) -> DataFrame:
    """Both tables with lot and visits (boolean): the visitors of a key in lots of about ``VISITORS``, its groups in each of them."""
    lots = stored(visits.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("lots")), "lots")
    lots = F.broadcast(lots) if lots.count() <= 100_000 else lots
    inside = groups.join(lots, "key").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("visits", F.lit(False)).drop("lots")
    come = visits.join(lots, "key").withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")).withColumn("visits", F.lit(True)).drop("lots")
    return inside.unionByName(come, allowMissingColumns=True)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups, each before its visitors, -> links ``a, b`` across components."""
    lead, root = None, {}

    def find(c):
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for batch in batches:
        a, b = [], []
        names = ("key", "lot", "visits", "id", "component")
        for i, (key, lot, visits, doc, comp, s) in enumerate(zip(*(batch[c].to_pylist() for c in names), all_sets(batch["t"]), strict=True)):
            if not visits:
                lead, root = (key, lot), {}
                ids, comps, sizes, tokens, ends, owners = (np.frombuffer(batch[c][i].as_buffer(), d) for c, d in (("ids", np.int64), ("components", np.int64), ("sizes", np.int64), ("tokens", np.uint64), ("ends", np.int64), ("owners", np.uint32)))
                continue
            if (key, lot) != lead or not len(s) or not len(tokens):
                continue
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            at = at[tokens[at] == s]
            if len(at) * DEN < NUM * len(s):  # more than any member can share
                continue
            begin = np.where(at > 0, ends[at - 1], 0)
            n = ends[at] - begin
            shared = np.bincount(owners[np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(ids))
            for g in np.argsort(-shared, kind="stable").tolist():
                if shared[g] * DEN < NUM * len(s):
                    break
                if (NUM + DEN) * shared[g] >= NUM * (len(s) + sizes[g]) and find(int(comps[g])) != find(comp):
                    a.append(int(ids[g]))
                    b.append(doc)
                    root[find(int(comps[g]))] = find(comp)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def through_matrix(homes: DataFrame, visits: DataFrame, texts: DataFrame) -> DataFrame:
    """Members and visitors of groups (both ``key, id, component``) -> the links ``a, b`` between components."""
    texts = texts.filter(might_hold(homes.select("id").union(visits.select("id")), "id")(F.col("id"))).select("id", "t")
    every = dealt(stored(matrix(homes, texts), "matrix"), visits.select("key", "id", "component"))
    # Both sides grow with the corpus: never a broadcast.
    come = every.filter("visits").select("key", "lot", "visits", "id", "component").hint("merge").join(texts, "id")
    rows = every.filter("not visits").unionByName(come, allowMissingColumns=True).repartition("key", "lot").sortWithinPartitions("key", "lot", "visits")
    return rows.mapInArrow(opened, "a bigint, b bigint")


def neighbours(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among candidate pairs ``a, b`` (a < b), ``u``: tokens of a. Those a that have one smallest neighbour make a group, which b visits."""
    least = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("home"))
    heads = edges.groupBy(F.col("a").alias("id")).agg(F.max("u").alias("n")).join(least, "id", "left").withColumn("home", F.coalesce("home", "id"))
    parts = heads.groupBy("home").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens")).withColumn("parts", parts_of("k", "tokens"))
    homes = heads.join(parts, "home").select(F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("key"), "id", F.col("id").alias("component"))
    homes = stored(homes, "homes")
    visits = edges.join(homes.select("key", F.col("id").alias("a")), "a").select("key", F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return through_matrix(homes, stored(visits, "visits"), texts)


def in_lots(blocks: DataFrame) -> DataFrame:
    """Rows by block, with ``lots``: once for each lot of the block."""
    return blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")


def could_link(n: str, rest: str, least: str, far: str):
    """Whether a set of ``n`` tokens, ``rest`` of them from the first common one on, can be linked with one of ``least`` tokens at least and at most ``far`` from there on."""
    return ((NUM + DEN) * F.least(rest, far) >= NUM * (F.col(n) + F.col(least))) & (DEN * F.col(n) >= NUM * F.col(least))


def that_could_link(members: DataFrame) -> DataFrame:
    """``members`` (block, id, component, stands, n, place) whose block spans components and lets them link, with ``rest, lots, lot``.

    A block with over 1 / HOT of all rows is cut into lots in proportion; there are fewer than HOT such blocks.
    """
    members = stored(members.withColumn("rest", F.col("n") - F.col("place") + 1), "members")
    blocks = members.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("rest").alias("far"))
    blocks = stored(blocks, "blocks")
    total = blocks.agg(F.sum("k")).first()[0] or 1
    large = F.broadcast(blocks.filter(F.col("k") * HOT > total).select("block", F.ceil(F.col("k") * HOT / total).cast("int").alias("lots")))
    spread = lambda rows: rows.join(large, "block", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    members = spread(members).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))
    several = in_lots(spread(blocks.filter("lo <> hi").select("block", "least", "far")))
    return members.join(several, ["block", "lot"]).filter(could_link("n", "rest", "least", "far")).drop("least", "far", "place")


def open_groups(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components among documents of frequent tokens: ``block`` (the token), ``id, component``; what ``that_could_link`` adds, if given.

    A document has one home: the smallest member that most of its blocks have. Those of one home are a group, cut into parts
    of about ``CHUNK`` members; a large component has parts of its own, which its own documents don't visit. Only documents
    that stand for others (``stands``) are members. Two documents that share a block meet in one of their homes: the
    document of the smaller visits the larger; those that are no members visit every home.
    """
    if "stands" not in members.columns:
        members = members.select("*", F.lit(True).alias("stands"), F.lit(1).alias("n"), F.lit(1).alias("rest"), F.lit(1).alias("lots"), F.lit(0).alias("lot"))
    inside = members.filter("stands")
    first = in_lots(inside.groupBy("block", "lots").agg(F.min("id").alias("first")))
    votes = inside.join(first, ["block", "lot"]).groupBy("id", "component", "n", "first").agg(F.count(F.lit(1)).alias("votes"))
    homes = votes.groupBy("id", "component", "n").agg(F.max_by("first", F.struct("votes", -F.col("first"))).alias("home"))
    sizes = homes.groupBy("home", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens")).withColumn("parts", parts_of("k", "tokens"))
    own = F.col("parts") > 1
    small = sizes.filter(~own).groupBy("home").agg(F.sum("k").alias("k"), F.sum("tokens").alias("tokens")).select("home", parts_of("k", "tokens").alias("shared"))
    h = homes.join(sizes, ["home", "component"]).join(small, "home", "left")
    part = F.when(own, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    h = stored(h.select(F.xxhash64("home", F.when(own, F.col("component")), part).alias("key"), "id", "component"), "homes")
    ranks = h.groupBy("key").agg(F.count(F.lit(1)).alias("rank"))
    ranked = stored(h.join(ranks, "key").select("id", "key", F.struct("rank", "key").alias("rank")), "ranked")
    there = inside.join(ranked, "id").groupBy("block", "lots", "key", "rank").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("far"))
    come = members.join(ranked.select("id", F.col("rank").alias("own")), "id", "left").select("block", "lot", "id", "component", "own", "n", "rest")
    apart = (F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component"))
    apart = apart & could_link("n", "rest", "least", "far") & (DEN * F.col("most") >= NUM * F.col("n"))
    visits = come.join(in_lots(there), ["block", "lot"]).filter(apart & (F.col("own").isNull() | (F.col("rank") >= F.col("own")))).select("key", "id", "component").distinct()
    return through_matrix(h, stored(visits, "visits"), texts)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach).

    Texts without words have no shingles and no links. Rows that repeat an id are one document with several texts: their
    links are put together. Null ids are one document, its component_id null if it has the smallest id. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    # A key of its own for each text of an id.
    texts = docs.select(F.xxhash64(name, F.coalesce(F.col(text), F.lit(""))).alias("id"), name.alias("doc"), F.col(text).alias("t"))
    n = parts_for(texts, "t", bucket_bytes)
    levels = spark.sparkContext.broadcast(frequency_levels(texts, n))
    found = stored(token_groups(texts, levels, n), "groups")
    rows = found.filter(F.col("kind") == DOC).select(F.col("a").alias("id"), F.col("b").alias("doc"), F.col("c").alias("n_shingles"), F.col("x").alias("hot_n"), F.col("y").alias("hot"), "u", "v")
    # Equal sets, and several texts of an id.
    equal = rows.filter("n_shingles > 0").groupBy("u", "v", "n_shingles").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last").drop("last")
    equal = rows.join(equal, ["u", "v", "n_shingles"]).select("a", F.col("id").alias("b"))
    again = rows.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last").drop("last")
    equal = equal.unionByName(rows.join(again, "doc").select("a", F.col("id").alias("b")))
    # Candidate pairs, and what bounds them.
    pairs = found.filter(F.col("kind").isin(PAIR, STAR)).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("x").alias("x"), F.max("y").alias("y"), F.max("u").alias("u"), F.max("v").alias("v"))
    for end in "uv":
        pairs = pairs.withColumn(f"{end}_tail", F.shiftright(end, TAIL)).withColumn(end, F.col(end).bitwiseAND(F.lit(LONGEST)))
    fits = (NUM * F.col("u") <= DEN * F.col("v")) & (NUM * F.col("v") <= DEN * F.col("u"))
    # Beyond the last common rare token, and beyond the rare tokens of the first quarter that ends first.
    most = F.col("c") + F.least(F.col("u") - F.col("x"), F.col("v") - F.col("y"), F.greatest("u_tail", "v_tail"))
    pairs = pairs.filter(fits & ((F.col("c") == 0) | ((NUM + DEN) * most >= NUM * (F.col("u") + F.col("v"))))).select("a", "b", "u")
    leaders = found.filter(F.col("kind") == LEADER).select("a", "b")
    heads = leaders.join(leaders.groupBy("a").agg(F.min("b").alias("first")), "a").filter("b <> first").select(F.col("first").alias("a"), "b", F.lit(1).cast("long").alias("u"))
    # Of sets with the same frequent tokens the smallest stands for those that these tokens link to it.
    hot = rows.filter("hot_n > 0").groupBy("hot", "hot_n").agg(F.min(F.struct("n_shingles", "id")).alias("least"))
    hot = rows.filter("hot_n > 0").join(hot, ["hot", "hot_n"]).select("id", F.col("n_shingles").alias("n"), F.col("least.id").alias("head"), F.col("least.n_shingles").alias("m"), "hot_n").distinct()
    hot = stored(hot.withColumn("near", (NUM + DEN) * F.col("hot_n") >= NUM * (F.col("n") + F.col("m"))), "hot")
    twins = hot.filter("near and id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"), F.when(F.col("id") < F.col("head"), F.col("n")).otherwise(F.col("m")).alias("u"))
    edges = pairs.unionByName(heads).unionByName(twins).groupBy("a", "b").agg(F.max("u").alias("u"))
    links = stored(neighbours(stored(edges, "edges"), texts).unionByName(equal), "links")
    comp = components(links)
    # What frequent tokens may still link.
    apart = hot.filter("id = head or not near").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = apart.groupBy("head", "n", "component", (F.col("id") == F.col("head")).alias("stands")).agg(F.min("id").alias("id"))
    members = found.filter(F.col("kind") == MEMBER).groupBy(F.col("a").alias("block"), F.col("b").alias("id")).agg(F.min("c").alias("place"))
    members = stored(that_could_link(members.join(apart.select("id", "component", "stands", "n"), "id")), "members")
    if not members.isEmpty():
        more = stored(open_groups(members, texts), "more")
        if not more.isEmpty():
            comp = joined_further(comp, more)
    least = comp.join(rows.select(F.col("id").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    least = stored(least, "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    # A component with over 1 / HOT of all linked rows is joined by broadcast; there are fewer than HOT of them.
    large = F.broadcast(least.filter(F.col("n") * HOT > total).select("component", F.col("least").alias("hot")))
    named = comp.join(large, "component", "left")
    named = named.filter("hot is null").join(least, "component").select("node", "least").unionByName(named.filter("hot is not null").select("node", F.col("hot").alias("least")))
    out = rows.join(named.withColumnRenamed("node", "id"), "id", "left").select("doc", "n_shingles", F.coalesce("least", "doc").alias("c"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias(doc_id), "n_shingles", real("c").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns; any other columns may be there.

    Rows that repeat the id that stays all stay, and so do rows with null ids that link to nothing smaller. No rows: no rows.
    """
    gone_id = unused("gone", docs)
    found = near_duplicates(docs, doc_id, text)
    gone = found.filter(~F.col("component_id").eqNullSafe(F.col(doc_id))).select(F.col(doc_id).alias(gone_id)).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone[gone_id]), "left_anti")


def op5(spark, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


ORACLE = r"""
WITH RECURSIVE lo AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM lo WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM lo WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT doc_id, doc_id FROM lo UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a)
SELECT lo.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM lo LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
