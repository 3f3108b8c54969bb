"""Jaccard join of shingle sets by token-combination prefixes.

Tokens are hashed word shingles. A token is frequent if it is among the FREQUENT most common
ones, else rare. The counts, one order for the whole corpus, are partial: see EXACT_SHARE. All sets are sorted by (count, hash), rare
tokens first. Of a set with n tokens at most n - ceil(t n) may be missing from a partner, so
the prefix needs that many signatures and one more: a rare token is a signature by itself;
frequent tokens are dealt to hash groups, the prefix is extended, and each pair of frequent
tokens of one group is a signature. A group with m tokens loses its last pair only when m - 1
tokens are missing, so it counts m - 1. Two sets over the threshold always share a signature.

Equal sets form one class, which joins once. Only components are asked for, so pairs within one need no check:
1. In each signature's bucket, every class is paired with the bucket's leader (the least in one
   of four fixed orders); each class keeps the three leaders it shares most signatures with. Such a
   pair is checked by size, then by parity bitmaps (their Hamming distance bounds the symmetric
   difference from below, so no link is lost), then exactly on the texts, salted by leader.
2. Large buckets that still hold several components are closed in rounds. Each class names its
   largest open buckets: one, then 4, 16 and so on, so a set with s signatures needs log4(s) rounds. A
   named bucket is compared in cells: a block of the classes outside of its largest component
   against a block of all. A cell checks the nearest pairs first, joins components as it goes and returns fewer
   links than it has components; the joined components are contracted before the next round,
   which closes most buckets. Of buckets with the same classes one is kept.
3. Small buckets that are still open give the pairs across components, each checked once.

Defined results: null or empty text, or text without words, has no shingles, links with
nothing and is its own component; with fewer words than a shingle the whole sequence is one;
rows that repeat a doc_id are documents of their own, with the result of their own text, and share
only the id; a null doc_id takes part in nothing and has a null component; other columns are
ignored; an empty table gives an empty result. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.components import components
from offerscope.llm.shared import written
from offerscope.llm.words import Words, crossing, lean, mix, word_tables

#: Most frequent tokens that are told apart; 16 bytes each in every Python worker.
FREQUENT = 1_500_000
#: Documents that must hold a token, at least, for it to be frequent.
LEAST_COUNT = 4
#: Tokens whose hash is in this lowest share of all are counted exactly: these come first in the order, so
#: prefixes consist of them. Of the others those are counted that a run of COUNT_RUN tokens holds twice, so one that
#: is spread thinly counts as rare; all sets are sorted by the same counts, and results stay exact.
EXACT_SHARE = 0.4
COUNT_RUN = 1_000_000
#: Leaders with which a class is paired in the first pass, those with the most shared signatures.
LEADERS = 3
#: Classes in a bucket that still holds several components, over which it is compared in cells and not by pairs.
BUCKET = 32
#: Shingles of each of the two blocks of a cell, about; a cell is compared in one step.
BLOCK = 400_000
#: Ids of candidates that are broadcast to keep other texts from the shuffle, if there are no more than so many.
BROADCAST_IDS = 1_000_000
#: Members checked with one leader in one task.
LEADER_SHARE = 500
_DOC = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (0x0, 0x5555555555555555, 0x3333333333333333, 0x7F0F0F0F0F0F0F0F)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, sorted by both."""
    g, ok = w.grams(k)
    at = np.flatnonzero(ok)
    doc, h = [w.doc[at]], [g[at]]
    first = w.first()
    count = np.diff(first)
    for n in range(1, k):
        own = np.flatnonzero(count == n)
        if len(own):
            whole, _ = w.grams(n)
            doc.append(own)
            h.append(mix(whole[first[own]] + np.uint64(n)))
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _counter(k: int) -> Callable:
    exact = np.uint64(int(EXACT_SHARE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                keep = (n > 1) | (h < exact)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

        for batch in batches:
            for w in word_tables(batch.column(0), lower=True):
                held.append(shingle_sets(w, k)[1])
                if sum(map(len, held)) >= COUNT_RUN:
                    yield from flush()
        yield from flush()

    return run


def frequent_tokens(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of at most FREQUENT tokens; the bound holds for any corpus."""
    seen = written(texts.select("text").mapInArrow(lean(_counter(k)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "counts")
    floor, total = LEAST_COUNT, 0
    sizes = seen.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("tokens"), F.min("n").alias("low")).orderBy(F.desc("step")).collect()  # some hundred rows at most
    for r in sizes:
        total += r.tokens
        if total > FREQUENT:
            break
        floor = r.low
    else:
        floor = LEAST_COUNT
    found = seen.filter(F.col("n") >= (floor if sizes else 1)).limit(FREQUENT).toArrow()
    h, n = (np.asarray(found.column(c).combine_chunks()) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Signatures that a set of n tokens needs."""
    return n - (percent * n + 99) // 100 + 1


def _pairs(h: np.ndarray, rare: int, need: int, percent: int, size: int) -> np.ndarray:
    """Signatures of pairs of frequent tokens (sorted by count, hash), for the size class of the set and the next that a partner may have."""
    out = []
    for c in sorted({size.bit_length() - 1, (size * 100 // percent).bit_length() - 1}):
        groups = max(1, ((100 - percent) << (c + 1)) // 200)
        seed = np.uint64((c * 0x632BE59BD9B4E019 + 1) & (2**64 - 1))
        g = (mix(h ^ seed) % np.uint64(groups)).astype(np.int64)
        worth = np.ones(len(g), np.int64)
        worth[np.unique(g, return_index=True)[1]] = 0
        enough = np.flatnonzero(rare + np.cumsum(worth) >= need)
        own = slice(0, enough[0] + 1 if len(enough) else len(g))
        order = np.lexsort((h[own], g[own]))
        hs, gs = h[own][order], g[own][order]
        for lag in range(1, len(gs)):
            same = gs[lag:] == gs[:-lag]
            if not same.any():
                break
            out.append(mix(hs[:-lag][same] * _DOC + mix(hs[lag:][same] + seed)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap with as many bits as the power of two at or above the set's size, 64 at least."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def far_apart(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """True if the bitmaps prove that the symmetric difference is too large."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (100 + percent) > (100 - percent) * (n + m)


def _signer(k: int, percent: int, frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            for w in word_tables(batch.column(2), lower=True):
                rows = w.hi - w.lo
                doc, h = shingle_sets(w, k)
                first = np.searchsorted(doc, np.arange(rows + 1))
                size = np.diff(first)
                total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix(h), mix(h ^ _DOC)], axis=1, dtype=np.uint64)], axis=1)
                s = total[:, first[1:]] - total[:, first[:-1]]
                cls = mix(s[0] + mix(s[1] ^ mix(size.astype(np.uint64)))).view(np.int64)
                at = crossing(known, h)
                count = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
                order = np.lexsort((h, count, doc))
                ranked = h[order]
                rare = np.diff(np.concatenate([[0], np.cumsum(count == 0)])[first])
                need = _need(size, percent)
                sigs, maps = [], []
                for i in range(rows):
                    a, b = first[i], first[i + 1]
                    own = ranked[a : a + min(rare[i], need[i])]
                    if rare[i] < need[i] and size[i]:
                        own = np.concatenate([own, _pairs(ranked[a + rare[i] : b], int(rare[i]), int(need[i]), percent, int(size[i]))])
                    sigs.append(own if 100 * size[i] >= percent * (size[i] + 1) else own[:0])  # else even one more or less is too far: only equal sets link
                    maps.append(_bitmap(h[a:b]))
                reach = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, rows), batch.column(1).slice(w.lo, rows), pa.array(size, pa.int64()), pa.array(cls), pa.ListArray.from_arrays(pa.array(reach), pa.array(np.concatenate(sigs).view(np.int64))), pa.array(maps, pa.binary())],
                    names=["doc_id", "key", "n", "cls", "sigs", "bits"],
                )

    return run


def _near(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = [not far_apart(x[i], y[i], n[i], m[i], percent) for i in range(len(n))]
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(4), out.column(5)], names=["u", "v"])

    return run


def _wide_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of one width for all sets of a cell: a row of 64-bit words each, about 4 bits a shingle."""
    mean = sum(map(len, sets)) // max(1, len(sets))
    bits = min(max(256, 1 << (4 * mean).bit_length()), 1 << 16)
    packed = [np.packbits(np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1) for h in sets]
    return np.stack(packed).view(np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = int((crossing(x, y) >= 0).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _forest(c: np.ndarray, role: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links of a cell join: fewer than the cell has components.

    Rows of role 0 or 2 ask, rows of role 1 or 2 answer. Pairs that bitmaps can't tell apart are checked exactly, the
    nearest first; a pair in one component by then needs no check.
    """
    n = np.array([len(h) for h in sets], np.int64)
    bits, now, found = _wide_bitmaps(sets), c.copy(), []
    for i in np.flatnonzero(role != 1).tolist():
        others = np.flatnonzero((role != 0) & (now != now[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if not len(others):
            continue
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (n[others] + n[i])
        for j in others[near][np.argsort(apart[near], kind="stable")].tolist():
            if now[j] != now[i] and _linked(sets[i], sets[j], percent):
                found.append((int(c[i]), int(c[j])))
                now[now == now[j]] = now[i]
    return found


def _cells(k: int, percent: int) -> Callable:
    """Rows sorted by (sig, i, j): pairs of components (u, v) that a link joins, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, ([], [], [])

        def flush():
            links = _forest(np.array(rows[0], np.int64), np.array(rows[1], np.int64), rows[2], percent) if rows[2] else []
            for r in rows:
                r.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            where = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            role, c = (batch.column(i).to_pylist() for i in (3, 4))
            for w in word_tables(batch.column(5), lower=True):
                doc, h = shingle_sets(w, k)
                first = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
                for i in range(w.hi - w.lo):
                    row = w.lo + i
                    if where[row] != cell:
                        yield flush()
                        cell = where[row]
                    rows[0].append(c[row]), rows[1].append(role[row]), rows[2].append(h[first[i] : first[i + 1]].copy())
        yield flush()

    return run


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows with the text of their document (rep, key); only asked texts are shuffled while their ids can be broadcast."""
    wanted = rows.select(F.col("rep").alias("doc_id")).distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted), "doc_id", "left_semi")
    return rows.join(texts, (texts.doc_id == rows.rep) & (texts.key == rows.key)).drop(texts.doc_id, texts.key)


def _open(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls, rep, key, n, c) of the buckets that hold several components, with the bucket's size, shingles and largest component."""
    parts = rows.groupBy("sig", "c").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    split = parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("count").alias("size"), F.sum("total").alias("total"), F.max(F.struct("count", "c", "total")).alias("top")).filter("parts > 1")
    return rows.join(split.select("sig", "size", "total", F.col("top.c").alias("top"), (F.col("total") - F.col("top.total")).alias("outside")), "sig")


def _one_of_equal_buckets(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls, ...) without buckets that hold the same classes as another one."""
    same = rows.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    return rows.join(same.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of open buckets by cell: blocks i of the classes outside of the largest component, against blocks j of all classes."""
    blocks = rows.withColumn("ni", F.ceil(F.col("outside") / BLOCK).cast("int")).withColumn("nj", F.ceil(F.col("total") / BLOCK).cast("int"))
    blocks = blocks.withColumn("bi", F.pmod(F.xxhash64("cls", F.lit(7)), "ni").cast("int")).withColumn("bj", F.pmod(F.xxhash64("cls"), "nj").cast("int")).withColumn("asks", F.col("c") != F.col("top"))
    cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    own = F.array(cell(F.col("bi"), F.col("bj"), 2))
    asked = F.transform(F.filter(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: j != F.col("bj")), lambda j: cell(F.col("bi"), j, 0))
    answer = F.transform(F.filter(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: ~F.col("asks") | (i != F.col("bi"))), lambda i: cell(i, F.col("bj"), 1))
    return blocks.select("sig", "rep", "key", "c", F.explode(F.when(F.col("asks"), F.concat(own, asked, answer)).otherwise(answer)).alias("at")).select("sig", "at.i", "at.j", "at.role", "c", "rep", "key")


def _by_cells(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of components (u, v) that links within the given open buckets join."""
    dealt = _with_text(_dealt(rows), texts).select("sig", "i", "j", "role", "c", "text")
    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(lean(_cells(k, percent)), "u long, v long")


def _checker(k: int, percent: int) -> Callable:
    """Rows sorted by (u, salt, member): the leader's text lies before those of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, salts, members, vs = (np.asarray(batch.column(i)) for i in range(4))
            links: list[tuple[int, int]] = []
            for w in word_tables(batch.column(4), lower=True):
                doc, h = shingle_sets(w, k)
                first = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
                for i in range(w.hi - w.lo):
                    row, mine = w.lo + i, h[first[i] : first[i + 1]]
                    if not members[row]:
                        leader, own = (us[row], salts[row]), mine
                    elif leader == (us[row], salts[row]) and _linked(own, mine, percent):
                        links.append((int(us[row]), int(vs[row])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among candidate pairs of classes (a, b)."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_u"), F.col("bits").alias("bits_u"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_v"), F.col("bits").alias("bits_v"))
    pairs = pairs.join(left, "a").join(right, "b").filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    pairs = written(pairs.select("n_u", "n_v", "bits_u", "bits_v", "a", "b").mapInArrow(lean(_near(percent)), "u long, v long"), "pairs")
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / LEADER_SHARE).cast("int").alias("salts"))
    leaders = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("u").alias("v"))
    asked = pairs.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), "salts").cast("int").alias("salt"), F.lit(True).alias("member"), "v").unionByName(leaders)
    asked = written(asked.join(classes.select(F.col("cls").alias("v"), "rep", "key"), "v"), "asked")
    rows = _with_text(asked, texts).select("u", "salt", "member", "v", "text")
    rows = rows.repartition(F.col("u"), F.col("salt")).sortWithinPartitions("u", "salt", "member")
    return written(rows.mapInArrow(lean(_checker(k, percent)), "u long, v long"), "links")


def _classes_of_documents(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, key, n, component) of each row (doc_id, key, text); the component is a class, null without doc_id or shingles."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k))
    sets = written(docs.mapInArrow(lean(_signer(k, percent, frequent)), "doc_id long, key long, n long, cls long, sigs array<long>, bits binary"), "sets")
    live = sets.filter("doc_id is not null and n > 0")
    reps = live.groupBy(F.col("cls").alias("c")).agg(F.min(F.struct("doc_id", "key")).alias("first")).select("c", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("rep_key"))
    classes = live.join(reps, (live.doc_id == reps.rep) & (live.key == reps.rep_key) & (live.cls == reps.c)).dropDuplicates(["cls"])
    classes = written(classes.select("cls", "rep", "key", "n", "bits"), "classes")
    texts = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "key"]) if sets.groupBy("doc_id", "key").count().filter("count > 1 and doc_id is not null").limit(1).count() else docs.filter("doc_id is not null")

    rows = live.select("cls", F.explode("sigs").alias("sig"))
    order = F.element_at(F.array(*(F.lit(x).cast("long") for x in _ORDERS)), (F.pmod("sig", F.lit(len(_ORDERS))) + 1).cast("int"))
    buckets = rows.groupBy("sig").agg(F.min(F.col("cls").bitwiseXOR(order)).alias("low"), F.max(F.col("cls").bitwiseXOR(order)).alias("high")).filter("low < high")
    shared = written(rows.join(buckets.select("sig", F.col("low").bitwiseXOR(order).alias("leader")), "sig").select("sig", "cls", "leader").distinct(), "buckets")
    stars = shared.filter("cls <> leader").groupBy(F.col("leader").alias("a"), F.col("cls").alias("b")).count()
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))  # a class has no more leaders than signatures
    found = components(_verified(stars.withColumn("place", place).filter(F.col("place") <= LEADERS).select("a", "b"), classes, texts, k, percent))
    merges = [found]

    placed = shared.select("sig", "cls").join(classes.select("cls", "rep", "key", "n"), "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component")
    left = written(_one_of_equal_buckets(_open(placed)), "open")
    share = 1
    while left.filter(F.col("size") > BUCKET).limit(1).count():
        # each class names its largest open buckets; these are compared whole and are done with
        rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("size"), "sig"))
        named = written(left.filter(F.col("size") > BUCKET).withColumn("rank", rank).filter(F.col("rank") <= share).select("sig").distinct(), "named")
        merges.append(components(_by_cells(left.join(named, "sig", "left_semi"), texts, k, percent)))
        left = written(_open(_merged(left.join(named, "sig", "left_anti").drop("size", "total", "top", "outside"), merges[-1])), "open")
        share *= 4
    few = left.filter("c <> top").select("sig", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    pairs = few.join(left.select("sig", "cls", "n", "c"), "sig").filter(f"c_a <> c and 100 * least(n_a, n) >= {percent} * greatest(n_a, n)").select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
    if left.limit(1).count():
        links = _verified(pairs, classes, texts, k, percent)
        home = left.select("cls", "c").distinct()
        merges.append(components(links.join(home.select(F.col("cls").alias("u"), F.col("c").alias("cu")), "u").join(home.select(F.col("cls").alias("v"), F.col("c").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
    end = classes.select("cls", F.col("cls").alias("c"))
    for step in merges:
        end = _merged(end, step)
    out = live.select("doc_id", "key", "n", "cls").join(end, "cls").select("doc_id", "key", "n", F.col("c").alias("component"))
    return out.unionByName(sets.filter("doc_id is null or n = 0").select("doc_id", "key", "n", F.lit(None).cast("long").alias("component")))


def _merged(rows: DataFrame, step: DataFrame) -> DataFrame:
    """Rows with c replaced by the component that it is in by now; step: (node, component) of those that changed."""
    return rows.join(step.withColumnRenamed("node", "c"), "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = written(_classes_of_documents(docs, k, percent), "rows")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id")).filter("component is not null")
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of each component's document with the least doc_id.

    If several rows of a component have this doc_id, the one whose text and columns have the least hashes stays. Rows without
    shingles or doc_id all stay, but for rows without shingles that repeat one wholly. Columns may have any names and types.
    """
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("key"), docs["text"].cast("string").alias("text"))
    rows = _classes_of_documents(own.select("doc_id", "key", "text"), k, percent).filter("doc_id is not null")
    rows = written(rows.withColumn("component", F.coalesce("component", "doc_id")).withColumn("alone", F.col("n") == 0).distinct(), "rows")
    kept = rows.groupBy("component", "alone").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    kept = kept.unionByName(rows.filter("alone").select("doc_id", "key")).distinct()
    found = own.drop("text").join(kept, ["doc_id", "key"])
    order = F.xxhash64(*(F.col("row")[f.name] for f in docs.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double", "boolean", "date", "timestamp")))
    one = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(order))  # the join has its rows in this order
    found = found.withColumn("place", one).filter("place = 1").select("row.*")
    return found.union(docs.filter("doc_id is null"))
